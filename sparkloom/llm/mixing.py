"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised: below 1 the
mixture is flatter than the sources are, above 1 sharper. The exponent is found by bisection:
each round evaluates the measure at 2**steps - 1 inner points of the interval in one
aggregation over the sources' totals, which is steps bisections at once, so only numbers
reach the driver however many sources there are.

Weights are realised as budgeted block permutations. Each source's documents are dealt to
blocks by hash; a pass over a source is a permutation of its blocks and of the documents
in each, another one for each pass. A source takes its budget's whole passes and then, of one
more pass, the blocks and documents up to the budget. A document's place in a pass is the
tokens before it: a prefix sum over runs of blocks, over the blocks of a run and within a
block, each in a window of its own, so no source is ordered in one task. Texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkernel import checkpoint


@dataclass(frozen=True)
class Params:
    """entropy: target entropy of the weights as a share of the largest possible, or None; repeats: most passes over a source.

    The exponent is the largest in [0, most] that reaches the entropy (1 without a target), moved towards 1 as
    far as the repetition limit needs (which wins; at 1 all sources have as many passes). epochs: tokens to
    emit, in multiples of the corpus, or None: as few as give every source one whole pass. The exponent has six decimals.
    """

    entropy: float | None = 0.97
    repeats: float = 4.0
    epochs: float | None = 1.0
    most: float = 8.0
    block_docs: int = 2048
    steps: int = 6
    rounds: int = 7
    seed: int = 7


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, at least 1: its tokens where no token column is given."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def _measure(totals: DataFrame, points: list[float], p: Params) -> list[tuple[float, float]]:
    """For each exponent: entropy of the weights as a share of the largest, and the most passes over a source."""
    grid = totals.select(F.col("tokens").cast("double").alias("t"), F.explode(F.array(*(F.lit(float(x)) for x in points))).alias("x"))
    top = totals.agg(F.max("tokens")).first()[0]
    rel = F.col("t") / F.lit(float(top))  # relative to the largest total, so that powers stay in range
    power = F.pow(rel, "x")
    spread = power * F.col("x") * F.log(rel)  # 0 where the power underflows
    rows = {r["x"]: r for r in grid.groupBy("x").agg(F.sum(power).alias("z"), F.sum(spread).alias("l"), F.max(power / rel).alias("most"), F.min(power / rel).alias("least"), F.sum(rel).alias("all"), F.count("*").alias("n")).collect()}
    out = []
    for x in points:
        r = rows[float(x)]
        share = (log(r["z"]) - r["l"] / r["z"]) / log(r["n"]) if r["n"] > 1 else 1.0
        passes = p.epochs * r["all"] * r["most"] / r["z"] if p.epochs is not None else r["most"] / r["least"] if r["least"] else float("inf")
        out.append((share, passes))
    return out


def _bisect(totals: DataFrame, p: Params, inside: float, outside: float, good: Callable) -> float:
    """The exponent furthest from inside on the way to outside for which good(measure) holds; it holds at inside and up to one point."""
    points = 2**p.steps - 1
    if good(_measure(totals, [outside], p)[0]):
        return outside
    for _ in range(p.rounds):
        inner = [inside + (outside - inside) * (i + 1) / (points + 1) for i in range(points)]
        n = sum(good(m) for m in _measure(totals, inner, p))
        inside, outside = (inner[n - 1] if n else inside), (inner[n] if n < points else outside)
    return inside


def exponent(totals: DataFrame, p: Params) -> float:
    """totals: source, tokens. See Params; 1 for a table without sources."""
    if totals.isEmpty():
        return 1.0
    x = 1.0 if p.entropy is None else _bisect(totals, p, 0.0, p.most, lambda m: m[0] >= p.entropy)
    if _measure(totals, [x], p)[0][1] > p.repeats:
        x = _bisect(totals, p, 1.0, x, lambda m: m[1] <= p.repeats)
    return round(x, 6)


def weights(totals: DataFrame, p: Params) -> DataFrame:
    """totals with weight (sum 1) and budget (tokens to emit) added, one row a source."""
    x = exponent(totals, p)
    facts = totals.agg(F.max("tokens").alias("top"), F.sum("tokens").alias("all")).first()
    top, every = float(facts["top"] or 1), float(facts["all"] or 0)
    power = F.pow(F.col("tokens") / F.lit(top), F.lit(x))
    sums = totals.agg(F.sum(power).alias("z"), F.min(power / F.col("tokens")).alias("least")).first()
    z, least = sums["z"] or 1.0, sums["least"] or 1.0
    weight = power / F.lit(z)
    budget = weight * F.lit(every * p.epochs) if p.epochs is not None else power / F.lit(least)
    return totals.withColumn("weight", weight).withColumn("budget", F.round(budget).cast("long"))


def place_hash(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts' text, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(x.cast("string") for x in parts))), 1, 15), 16, 10).cast("long")


def _before(tokens: str, by: list[str], order: list[str]) -> Column:
    """Tokens of the rows before, in a window."""
    return F.coalesce(F.sum(tokens).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ordered(classes: DataFrame, p: Params) -> DataFrame:
    """classes (source, key, tokens, bits, pass) with block and at: the tokens before it in that pass over its source.

    Blocks are 2**bits a source; runs of blocks are half of their bits, so no window has more rows than a
    block, or than the square root of a source's blocks.
    """
    bits = F.col("bits")
    dealt = classes.withColumn("block", F.call_function("shiftright", place_hash(F.lit(p.seed), F.col("key")), (F.lit(60) - bits).cast("int")))
    dealt = dealt.withColumn("order", place_hash(F.lit(p.seed), F.col("pass"), F.col("key")))
    blocks = dealt.groupBy("source", "pass", "bits", "block").agg(F.sum("tokens").alias("block_tokens"))
    blocks = blocks.withColumn("block_order", place_hash(F.lit(p.seed), F.col("pass"), F.lit("block"), F.col("block")))
    blocks = blocks.withColumn("run", F.call_function("shiftright", F.col("block_order"), (F.lit(60) - F.floor(bits / 2)).cast("int")))
    runs = blocks.groupBy("source", "pass", "run").agg(F.sum("block_tokens").alias("run_tokens"))
    runs = runs.withColumn("run_at", _before("run_tokens", ["source", "pass"], ["run"])).select(F.col("source").alias("s"), F.col("pass").alias("n"), F.col("run").alias("r"), "run_at")
    blocks = blocks.withColumn("in_run", _before("block_tokens", ["source", "pass", "run"], ["block_order", "block"]))
    same = lambda *pairs: F.expr(" AND ".join(f"{a} <=> {b}" for a, b in pairs))
    starts = blocks.join(runs, same(("source", "s"), ("pass", "n"), ("run", "r"))).select(F.col("source").alias("s"), F.col("pass").alias("n"), F.col("block").alias("b"), (F.col("run_at") + F.col("in_run")).alias("block_at"))
    inside = dealt.withColumn("inside", _before("tokens", ["source", "pass", "block"], ["order", "key"]))
    return inside.join(starts, same(("source", "s"), ("pass", "n"), ("block", "b"))).withColumn("at", F.col("block_at") + F.col("inside")).drop("s", "n", "b", "order", "inside", "block_at")


def _classes(docs: DataFrame, p: Params, id_col: str, source_col: str, text_col: str, token_col: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, source, tokens, key) and their classes by source and key, with weight, bits, whole passes and rest."""
    text = F.col(f"`{text_col}`")
    tokens = word_count(text) if token_col is None else F.greatest(F.col(f"`{token_col}`").cast("long"), F.lit(1))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    sized = checkpoint(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(tokens, F.lit(1)).alias("tokens"), key.alias("key")))
    totals = checkpoint(sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / p.block_docs))).cast("int")
    shares = weights(totals, p).select(F.col("source").alias("s"), F.col("tokens").alias("total"), "weight", "budget", bits.alias("bits"))
    merged = sized.groupBy("source", "key").agg(F.sum("tokens").alias("tokens"))
    whole = F.floor(F.col("budget") / F.col("total"))
    classes = merged.join(shares, F.col("source").eqNullSafe(F.col("s"))).withColumn("whole", whole).withColumn("rest", F.col("budget") - whole * F.col("total"))
    return sized, classes.drop("s", "budget", "total")


def plan(docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", token_col: str | None = None) -> DataFrame:
    """One row a document: doc_id, source, tokens, weight (its source's), copies (times it is emitted), block and at (its place in its source's last pass).

    A null source is a source of its own. Documents count at least one token, null texts too. The last
    document that a budget reaches is emitted if the budget ends at its middle or later. Rows of one id and
    source go together: one place, as many copies each. Rows of null id are told apart by their texts.
    """
    p = params or Params()
    sized, classes = _classes(docs, p, id_col, source_col, text_col, token_col)
    placed = ordered(classes.withColumn("pass", F.col("whole")), p)
    copies = F.col("whole") + F.when(F.col("at") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    found = placed.select(F.col("source").alias("s"), F.col("key").alias("k"), "weight", copies.cast("long").alias("copies"), "block", "at")
    return sized.join(found, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k"))).select("doc_id", "source", "tokens", "weight", "copies", "block", "at")


def schedule(docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", token_col: str | None = None) -> DataFrame:
    """One row for each time that a document is emitted: doc_id, source, pass (from 0), block and at (tokens before it in that pass over its source).

    Ordered by pass and at, a source's rows are its block permutations up to its budget. Cases as in plan().
    """
    p = params or Params()
    sized, classes = _classes(docs, p, id_col, source_col, text_col, token_col)
    placed = ordered(classes.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole")))), p)
    kept = placed.where((F.col("pass") < F.col("whole")) | (F.col("at") + F.col("tokens") / 2 <= F.col("rest")))
    kept = kept.select(F.col("source").alias("s"), F.col("key").alias("k"), "pass", "block", "at")
    return sized.join(kept, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k"))).select("doc_id", "source", "pass", "block", "at")


def mix(docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with every row as often as plan() has it, columns unchanged.

    Rows that share an id are each emitted as often as the one of them with most copies; rows of null id are kept once.
    """
    planned = plan(docs.where(F.col(f"`{id_col}`").isNotNull()), params, id_col, source_col, text_col)
    found = planned.groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    many = docs.join(found.where("__copies > 0"), docs[id_col] == F.col("__id")).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return many.select(*names).union(docs.where(F.col(f"`{id_col}`").isNull()))
