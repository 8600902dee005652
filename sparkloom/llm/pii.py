"""Personal data in text, with DataFrame functions only.

Expressions propose spans, validators confirm them (Luhn, mod-97, part and digit limits)
and context words near a span adjust its score. Everything is one projection over the
scan: no shuffle and no Python, so its cost follows the text.

Places: an expression's matches and the gaps between them (split by the same expression)
are listed together; prefix sums of their lengths, taken in blocks so that a text of many
matches stays far from quadratic, give the starts in code points.

Expressions are possessive and may only begin where a run of their characters begins (or
the previous match ended), which finds the same leftmost matches without rescanning runs.
That does not hold for account codes, which text of the same characters may follow: a known
country's code has its country's length; of another's, every end at a blank is tried.

Null and empty texts have no spans; repeated rows give repeated results; null ids pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = "array<struct<kind:string,start:int,stop:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """pattern: Java expression. gate: a text that does not match it has no match of pattern. base: listed spans that always stay.

    score holds without context, and rises by 0.3 where a context word stands within 48 characters before the span.
    """

    name: str
    pattern: str
    gate: str
    context: str
    score: float
    base: bool = True


#: Length of an account code by country (the IBAN registry).
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "(?:" + "|".join(sorted(" ".join(IBAN.values()).split())) + ")"
_ACCOUNT = "|".join(
    [
        *(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN.items()),
        rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_KNOWN}[0-9]{{2}}))?+[A-Z0-9]){{11,30}}(?![A-Za-z0-9])",
    ]
)

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"mail|contact|write|address|correo|courriel", 0.7),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.", r"\bip\b|host|server|address", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){13}", r"card|visa|master|amex|credit|pay", 0.6),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"phone|call|tel|mobile|fax|contact", 0.6),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_ACCOUNT})", r"[A-Z]{2}[0-9]{2}\x20?+[A-Z0-9]", r"iban|account|bank|transfer|konto", 0.7, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"ssn|social security|tax", 0.3, False),
    Kind("secret", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", "AKIA", r"key|secret|token|aws", 0.7, False),
)
#: A span that is not base counts from this score on.
LEAST_SCORE = 0.5


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    turned = F.reverse(number)
    digit = lambda i: F.ascii(F.substring(turned, i, F.lit(1))) - 48
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code without blanks has right check digits: its digits, with letters as 10 to 35, are 1 modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    step = lambda acc, ch: F.when(ch.rlike("[0-9]"), (acc * 10 + F.ascii(ch) - 48) % 97).otherwise((acc * 100 + F.ascii(ch) - 55) % 97)
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def account(found: Column) -> Column:
    """The longest start of a match that is a valid account code and ends with the match (of a known country: that alone) or before a blank; '' if there is none."""
    blanks = F.split(found, " ")
    sizes = F.when(found.rlike(f"^{_KNOWN}"), F.array(F.size(blanks))).otherwise(F.sequence(F.size(blanks), F.lit(1), F.lit(-1)))
    starts = F.transform(sizes, lambda n: F.array_join(F.slice(blanks, F.lit(1), n), " "))
    right = lambda c: F.when(F.length(F.replace(c, F.lit(" "), F.lit(""))).between(15, 34), mod97(F.replace(c, F.lit(" "), F.lit("")))).otherwise(False)
    return F.coalesce(F.get(F.filter(starts, right), F.lit(0)), F.lit(""))


def bare(kind: str, found: Column) -> Column:
    """What a match's validator looks at."""
    return digits(found) if kind in ("card", "phone") else account(found) if kind == "iban" else found


def valid(kind: str, code: Column) -> Column:
    if kind == "ip":
        return code.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]?)(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(code).between(14, 19), luhn(code)).otherwise(False)
    if kind == "phone":
        return F.length(code).between(10, 15)
    if kind == "iban":
        return code != ""
    if kind == "ssn":
        return ~code.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


#: Matches in a block of the prefix sums.
BLOCK = 64


def sums(xs: Column) -> Column:
    """0 and the running sums of xs."""
    return F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def with_spans(df: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """df (with column __text) with the column spans added.

    Step by step for all kinds at once: matches, gaps, lengths, sums within blocks, sums of blocks, spans.
    """
    col = lambda k, part: F.col(f"__{k.name}_{part}")
    step = lambda part, make: {f"__{k.name}_{part}": make(k) for k in kinds}
    text = F.col("__text")
    strings, ints, no_spans = F.array().cast("array<string>"), F.array().cast("array<int>"), F.array().cast(_SPAN)
    some = lambda k: F.size(col(k, "found")) > 0
    df = df.withColumn("__text", F.coalesce("__text", F.lit("")))
    df = df.withColumns(step("found", lambda k: F.when(text.rlike(k.gate), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(strings)))
    df = df.withColumns(step("gaps", lambda k: F.when(some(k), F.split(text, k.pattern, -1)).otherwise(strings)) | step("code", lambda k: F.transform(col(k, "found"), lambda m: bare(k.name, m))))
    df = df.withColumns(step("sizes", lambda k: F.zip_with(col(k, "gaps"), col(k, "found"), lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))))
    last = lambda k: F.floor((F.size(col(k, "found")) - 1) / BLOCK).cast("int")
    df = df.withColumns(
        step("blocks", lambda k: F.when(some(k), F.transform(F.sequence(F.lit(0), last(k)), lambda i: sums(F.slice(col(k, "sizes"), i * BLOCK + 1, F.lit(BLOCK))))).otherwise(F.array().cast("array<array<int>>")))
    )
    df = df.withColumns(step("before", lambda k: F.when(some(k), sums(F.transform(col(k, "blocks"), lambda b: F.element_at(b, -1)))).otherwise(ints)))

    def spans(k: Kind) -> Column:
        at = lambda part, i: F.get(col(k, part), i)
        start = lambda i: F.get(F.get(col(k, "blocks"), F.floor(i / BLOCK).cast("int")), i % BLOCK) + F.get(col(k, "before"), F.floor(i / BLOCK).cast("int")) + F.length(at("gaps", i))
        made = F.transform(
            col(k, "found"),
            lambda m, i: F.struct(
                F.lit(k.name).alias("kind"),
                start(i).alias("start"),
                (start(i) + F.length(at("code", i) if k.name == "iban" else m)).alias("stop"),
                F.when(valid(k.name, at("code", i)), F.lit(k.score) + F.when(F.lower(F.right(at("gaps", i), F.lit(48))).rlike(k.context), 0.3).otherwise(0.0)).otherwise(0.0).alias("score"),
            ),
        )
        return F.when(some(k), F.filter(made, lambda s: s["score"] >= (1e-9 if k.base else LEAST_SCORE))).otherwise(no_spans)

    df = df.withColumns(step("spans", spans))
    df = df.withColumn("spans", ordered(F.concat(*(col(k, "spans") for k in kinds)), kinds))
    return df.drop(*(f"__{k.name}_{part}" for k in kinds for part in ("found", "gaps", "code", "sizes", "blocks", "before", "spans")))


def ordered(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    """Spans by start, then kind as listed."""
    rank = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k.name), F.lit(i))))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.element_at(rank, s["kind"]).alias("b"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and spans, an array of (kind, start, stop, score) by start, then kind; code points, stop exclusive."""
    return with_spans(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("__text")), kinds).select("doc_id", "spans")


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text_col: str = "text") -> DataFrame:
    """docs with every confirmed span replaced by its kind in angle brackets; a span that begins inside an earlier one's is merged into it.

    All columns are kept, n_chars (if there is one of whole numbers) is set anew for texts that change; null texts stay null.
    """
    names = docs.columns
    df = with_spans(docs.select(*(F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(names)), F.col(f"`{text_col}`").alias("__text")), kinds)
    # merged spans: a span that begins before the last one's stop widens it
    start = F.array().cast(_SPAN)
    widen = lambda acc, s: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["kind"].alias("kind"), F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"), s["score"].alias("score"))))
    df = df.withColumn("__merged", F.when(F.size("spans") > 0, F.aggregate("spans", start, lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["stop"]), widen(acc, s)).otherwise(F.concat(acc, F.array(s))))).otherwise(start))
    text, m = F.col("__text"), F.col("__merged")
    pieces = F.transform(m, lambda s, i: F.concat(F.substring(text, F.when(i == 0, F.lit(1)).otherwise(F.try_element_at(m, F.greatest(i, F.lit(1)))["stop"] + 1), s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(m, F.greatest(i, F.lit(1)))["stop"])), F.lit("<"), s["kind"], F.lit(">")))
    masked = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(m, -1)["stop"] + 1, F.length(text)))
    df = df.withColumn("__masked", F.when(F.size(m) > 0, masked))
    out = []
    for i, c in enumerate(names):
        value = F.col(f"__in_{i}")
        if c == text_col:
            value = F.coalesce("__masked", value)
        elif c == "n_chars":
            value = F.when(F.col("__masked").isNotNull(), F.length("__masked")).otherwise(value).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return df.select(*out)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counts(found: DataFrame) -> DataFrame:
    """find_pii()'s rows as doc_id, counts and digest of the base kinds, all spans as text and their number."""
    base = [k.name for k in KINDS if k.base]
    number = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    digest = F.sha2(F.encode(joined(F.filter("spans", lambda s: s["kind"].isin(base))), "utf-8"), 256).alias("base_sha256")
    return found.select("doc_id", *(number(k) for k in base), digest, joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
