"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in each round every shingle is hashed to a bin and a value; a bin keeps the
least value of the first round that reaches it. Documents whose bins are not all
filled after the random rounds end with one fixed round per bin, so every coordinate
fills; the share of equal coordinates of two sketches estimates their Jaccard
similarity with Chernoff-type concentration.

Plan:
1. one pass over the texts: set size, 128-bit key of the set, sketch, band keys;
2. exact copies fall together by set key (partial aggregation), one class each;
3. classes sharing a band key are joined to the least class of that key, never pairwise;
   connected components of these links are the candidate groups;
4. a candidate group is cut in blocks by hash, most groups are one block; blocks are verified in
   rounds. First each block by itself, so that a text is shipped once; then, in groups of several
   blocks, what is confirmed is contracted to its least member and these are verified likewise,
   until no round links any more; last, what is left of groups that did not become one is compared
   block by block, members that are already connected excepted. In a task sketches are compared in numpy,
   the most similar pairs are confirmed first on full sets, and pairs already connected are skipped;
   a member's least partner returns, so no rows grow with the square of a group;
5. components of the confirmed links are carried back to all documents by set key.

With 40 bands of 6 rows a pair at similarity 0.85 is missed with probability 6e-9, and the
estimate (6 standard deviations of slack) drops one with about 1e-8.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .graph import components, salted
from .textkernel import checkpoint


@dataclass(frozen=True)
class Params:
    """percent: links have 100 * intersection >= percent * union. block, block_shingles: classes of a verification block and shingles of all."""

    shingle: int = 5
    percent: int = 85
    bands: int = 40
    rows: int = 6
    rounds: int = 32
    block: int = 2048
    block_shingles: int = 1_000_000

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Equal coordinates below which a pair is surely not similar: 6 standard deviations under the threshold."""
        p = self.percent / 100
        return max(1, int(self.size * p - 6 * (self.size * p * (1 - p)) ** 0.5))


def shingle_sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each document, and where each document's begin."""
    b = K.read(texts, lower=True)
    counts = np.diff(b.word_at)
    first, hashes = b.windows(k)
    doc = b.doc_of[first]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        hashes = np.concatenate([hashes, K.ranges(K.prefix(b.words), b.word_at[short], b.word_at[short + 1])])
        doc = np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketches(hashes: np.ndarray, at: np.ndarray, size: int, rounds: int) -> np.ndarray:
    """One row of size coordinates a set; rows of empty sets hold the largest value only."""
    n, empty = len(at) - 1, np.uint64(0xFFFFFFFFFFFFFFFF)
    flat = np.full(n * size, empty, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(at))
    live, live_doc = hashes, doc
    for r in range(rounds):
        if not len(live):
            break
        h = K.mix(live + np.uint64((r + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        np.minimum.at(flat, live_doc * size + bins.astype(np.int64), np.uint64(r << 32) | (h & np.uint64(0xFFFFFFFF)))
        open_docs = np.unique(live_doc)
        open_docs = open_docs[(flat.reshape(n, size)[open_docs] == empty).any(axis=1)]
        keep = np.zeros(n, bool)
        keep[open_docs] = True
        chosen = keep[live_doc]
        live, live_doc = live[chosen], live_doc[chosen]
    table = flat.reshape(n, size)
    for d in np.unique(live_doc):  # the fixed rounds: bin b takes the least value of all elements in round rounds + b
        missing = np.flatnonzero(table[d] == empty)
        own = hashes[at[d] : at[d + 1]]
        step = max(1, 1_000_000 // len(own))
        for a in range(0, len(missing), step):
            part = missing[a : a + step]
            h = K.mix(own[None, :] + ((part.astype(np.uint64) + np.uint64(rounds + 1)) * np.uint64(0xA0761D6478BD642F))[:, None])
            table[d, part] = ((part.astype(np.uint64) + np.uint64(rounds)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)).min(axis=1)
    return table


#: Of the two halves of a set's key.
KEY_SALTS = (0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7)


def fingerprints(batch: pa.RecordBatch, p: Params) -> dict:
    hashes, at = shingle_sets(K.texts_of(batch, "text"), p.shingle)
    sizes = np.diff(at)
    table = sketches(hashes, at, p.size, p.rounds)
    keys = np.zeros((len(sizes), p.bands), np.uint64)
    for r in range(p.rows):
        keys = K.mix(keys * np.uint64(0x9FB21C651E98DF25) + table[:, r :: p.rows] + np.arange(p.bands, dtype=np.uint64))
    sums = [set_key(hashes, at, salt) for salt in KEY_SALTS]
    full = sizes > 0
    small = (K.mix(table) & np.uint64(0xFF)).astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(np.where(full, p.bands, 0))]).astype(np.int32)
    return {
        "doc_id": batch["id"].cast(pa.int64()),
        "n_shingles": sizes,
        "k1": sums[0],
        "k2": sums[1],
        "sketch": pa.array([x.tobytes() for x in small], pa.binary()),
        "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel().view(np.int64))),
    }


class Forest:
    """Union-find over numbers below n; labels are of whole arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = int(self.root[x])
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)
        return x != y

    def labels(self) -> np.ndarray:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        return self.root


def stars(rows: list[tuple], forest: Forest) -> list[tuple[int, int]]:
    """Each label of rows with the least label of its tree, where that is another one."""
    least: dict[int, int] = {}
    root = forest.labels().tolist()
    for x, r in zip(root, rows):
        least[x] = min(r[5], least.get(x, r[5]))
    return sorted({(r[5], least[x]) for x, r in zip(root, rows) if r[5] != least[x]})


def set_key(hashes: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A key of each set that does not depend on its order."""
    state = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(K.mix(hashes ^ np.uint64(salt)), out=state[1:])
    return (state[at[1:]] - state[at[:-1]]).view(np.int64)


def linked(rows: list[tuple], p: Params) -> list[tuple[int, int]]:
    """Links among rows (side, rep, sketch, text, k1, label) of one block or pair of blocks: a rep, and the least rep that it is connected with here.

    With both sides in rows, pairs across the sides are compared and reps are those of labels, else all pairs.
    Rows of one label are connected already. Rows whose text is not the set of key k1 are another text
    of the same id and left out. Rows are put in order first: the result does not depend on how a shuffle
    delivered them, else a task that runs again could return other links.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[4]))
    arrays: list[np.ndarray] = []
    own: list[np.ndarray] = []
    start = 0
    while start < len(rows):
        stop, size = start, 0
        while stop < len(rows) and (size < K.BUFFER_BYTES or stop == start):
            size += len(rows[stop][3])
            stop += 1
        hashes, at = shingle_sets([r[3] for r in rows[start:stop]], p.shingle)
        own.append(set_key(hashes, at, KEY_SALTS[0]))
        arrays += [hashes[a:b] for a, b in zip(at[:-1], at[1:])]
        start = stop
    fits = np.flatnonzero(np.concatenate(own) == np.array([r[4] for r in rows])).tolist()
    fits = [i for n, i in enumerate(fits) if not n or rows[i][:2] + rows[i][4:5] != rows[fits[n - 1]][:2] + rows[fits[n - 1]][4:5]]  # repeated rows
    rows, arrays = [rows[i] for i in fits], [arrays[i] for i in fits]
    if len(rows) < 2:
        return []
    sides = np.array([r[0] for r in rows])
    sketch = np.stack([np.frombuffer(r[2], np.uint8) for r in rows])
    forest = Forest(len(rows))
    first: dict[int, int] = {}
    for i, r in enumerate(rows):
        forest.join(first.setdefault(r[5], i), i)
    forest.labels()

    def common(x: int, y: int) -> int:
        few, many = sorted((arrays[x], arrays[y]), key=len)
        at = np.minimum(np.searchsorted(many, few), len(many) - 1)
        return int((many[at] == few).sum())

    left = np.flatnonzero(sides == sides.min())
    across = len(left) < len(rows)
    right = np.flatnonzero(sides != sides.min()) if across else left
    sizes = np.array([len(a) for a in arrays])
    pairs = []
    for n, x in enumerate(left.tolist()):
        many = right if across else right[n + 1 :]
        equal = (sketch[many] == sketch[x]).sum(axis=1)
        lo, hi = np.minimum(sizes[many], sizes[x]), np.maximum(sizes[many], sizes[x])
        near = (equal >= p.least_equal) & (100 * lo >= p.percent * hi) & (forest.root[many] != forest.root[x])
        found = np.empty(int(near.sum()), [("e", np.int16), ("x", np.int32), ("y", np.int32)])
        found["e"], found["x"], found["y"] = -equal[near], x, many[near]
        pairs.append(found)
    todo = np.concatenate(pairs) if pairs else np.zeros(0)
    todo = todo[np.argsort(todo["e"], kind="stable")] if len(todo) else todo  # the most similar first: they connect soonest
    def similar(both, x, y):
        return 100 * both >= p.percent * (sizes[x] + sizes[y] - both)

    some = 4 * len(rows)  # these one by one; then all of a row's at once, as most are not similar
    for _, x, y in todo[:some].tolist():
        if forest.find(x) != forest.find(y) and similar(common(x, y), x, y):
            forest.join(x, y)
    todo, root = todo[some:], forest.labels()
    todo = todo[root[todo["x"]] != root[todo["y"]]] if len(todo) else todo
    if not len(todo):
        return stars(rows, forest)
    todo = todo[np.lexsort((todo["y"], todo["x"]))]
    flat = np.unique(np.concatenate(arrays), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1, bool)
    cuts = [0, *(np.flatnonzero(np.diff(todo["x"])) + 1).tolist(), len(todo)]
    for a, b in zip(cuts, cuts[1:]):
        x, ys = int(todo["x"][a]), todo["y"][a:b]
        root = forest.labels()
        ys = ys[root[ys] != root[x]]
        if len(ys) * 20_000 > len(flat):  # a pair costs as much as so many members
            mark[flat[at[x] : at[x + 1]]] = True
            both = np.add.reduceat(mark[flat], at[:-1], dtype=np.int64)[ys]
            mark[flat[at[x] : at[x + 1]]] = False
            for y in ys[similar(both, x, ys)].tolist():
                forest.join(x, y)
        else:
            for y in ys.tolist():
                if forest.find(x) != forest.find(y) and similar(common(x, y), x, y):
                    forest.join(x, y)
    return stars(rows, forest)


def verified(members: DataFrame, texts: DataFrame, p: Params, turn: int = 0, pairs: bool = False) -> DataFrame:
    """Links (a, b) of labels within blocks of the groups of members (rep, k1, sketch, n_shingles, comp, label), or with pairs across these blocks.

    Within blocks, a label is linked once; b is the least label. Blocks differ from turn to turn.
    """
    sized = salted(members, "comp", "rep", n=(F.count("*"), F.sum), all_shingles=(F.sum("n_shingles"), F.sum))
    blocks = F.greatest(F.ceil(F.col("n") / p.block), F.ceil(F.col("all_shingles") / p.block_shingles))
    sized = sized.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("blocks")))
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = total // p.block_shingles * 4 + 1  # tasks for the groups of one block: many to a task
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("own")) if pairs else F.array("own")
    cut = (
        texts.join(sized, "rep")
        .withColumn("other", F.explode(others))
        .withColumn("g", F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("comp"), F.lit(tasks))).otherwise(F.col("comp")))
        .select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "comp", "own", "rep", "sketch", "text", "k1", "label")
    )

    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        groups: dict[int, list] = {}
        for comp, *row in zip(*(table[c].to_pylist() for c in ("comp", "own", "rep", "sketch", "text", "k1", "label"))):
            groups.setdefault(comp, []).append(row)
        i, j = key[1].as_py(), key[2].as_py()
        found = [x for rows in groups.values() if len(rows) > 1 and (i == j or len({r[0] for r in rows}) == 2) for x in linked(rows, p)]
        K.release()
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return K.bound_batches(cut).groupBy("g", "i", "j").applyInArrow(verify, "a long, b long")


def confirmed_links(docs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) between class representatives that connect exactly what all links would."""
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("bucket", "lo")
    groups = checkpoint(components(banded.join(shared, "bucket").where("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b"))))
    texts = docs.select(F.col("id").cast("long").alias("rep"), F.encode("text", "utf-8").alias("text")).where("rep IS NOT NULL AND text IS NOT NULL")
    named = classes.select("rep", "k1", "sketch", "n_shingles").join(groups, F.col("rep") == F.col("node")).drop("node").withColumn("label", F.col("rep"))
    links = checkpoint(verified(named, texts, p))
    large = F.greatest(F.ceil(F.col("n") / p.block), F.ceil(F.col("all_shingles") / p.block_shingles)) > 1
    rest = checkpoint(salted(named, "comp", "rep", n=(F.count("*"), F.sum), all_shingles=(F.sum("n_shingles"), F.sum)).where(large).drop("n", "all_shingles"))
    if rest.isEmpty():
        return links
    texts = checkpoint(texts.join(rest.select("rep").distinct(), "rep"))
    found, more, turn = [links], links, 0
    while True:  # contraction: the least members of what is connected stand for the rest
        renamed = more.select(F.col("a").alias("label"), F.col("b").alias("least"))
        rest = checkpoint(rest.join(renamed, "label", "left").withColumn("label", F.coalesce("least", "label")).drop("least"))
        turn += 1
        more = checkpoint(verified(rest.where("rep = label"), texts, p, turn))
        if more.isEmpty():
            break
        found.append(more)
    apart = checkpoint(salted(rest, "comp", "rep", lo=(F.min("label"), F.min), hi=(F.max("label"), F.max)).where("lo < hi").drop("lo", "hi"))
    if not apart.isEmpty():
        found.append(verified(apart, texts, p, pairs=True))
    return functools.reduce(DataFrame.union, found)


def near_duplicates(docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents of fewer words than a shingle have their whole sequence as one; null, empty or
    blank texts have none, are linked with nothing and are kept. Rows with a null id take no
    part: component_id null, kept. Equal rows get equal results. An id is one node: if its rows differ
    in text, what any of these texts is linked with is reachable through it. Ids are whole numbers; a
    text id that is none is an error. An empty table gives no rows.
    """
    p = params or Params()
    schema = "doc_id long, n_shingles long, k1 long, k2 long, sketch binary, bands array<long>"
    prints = checkpoint(K.map_texts(docs, lambda b: fingerprints(b, p), schema, id_col, text_col))
    named = prints.where("n_shingles > 0 and doc_id is not null")
    classes = checkpoint(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    labels = components(checkpoint(confirmed_links(source, classes, p)))  # every step must see the same forest, computed once
    least = classes.select("k1", "k2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("comp", "rep").alias("least"))
    rest = prints.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = named.select("doc_id", "n_shingles", "k1", "k2").join(least, ["k1", "k2"]).select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return found.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
