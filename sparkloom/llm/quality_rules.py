"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark every word that lies in a repeated
n-gram of its document; the marked words' characters, and the characters of lines
that repeat an earlier line, are measured against the document's characters.

Runs as one pass over the scan (mapInArrow): no shuffle, memory bounded by a buffer
of about 1 MB of text, so a task can be run again anywhere.

Defined cases: null or empty text has no words and is rejected (fewer than min_words);
rows are judged one by one, so repeated rows give repeated results; null ids pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as K

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, repeat_chars long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Rules:
    """Limits as shares of a document's word characters, and repeat_percent in whole per cents of its words.

    max_repeat_chars holds for the characters covered by repeated n-grams of the given lengths.
    """

    min_words: int = 10
    window: int = 5
    repeat_percent: int = 20
    lengths: tuple[int, ...] = (2, 3, 4, 6, 8, 10)
    max_repeat_chars: tuple[float, ...] = (0.60, 0.40, 0.25, 0.20, 0.18, 0.16)
    max_dup_line_chars: float = 0.30
    max_symbols: float = 0.10


def repeated(buffer: K.Buffer, doc: np.ndarray, k: int, state: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """First words of the k-word windows that their document holds twice or more.

    A window can only repeat where its shorter head repeats, so the result for a smaller k may be given as among.
    """
    n = len(buffer.words)
    among = np.arange(n) if among is None else among
    among = among[among <= n - k]
    among = among[doc[among] == doc[among + k - 1]]
    keys = K.within(doc[among], K.ranges(state, among, among + k))
    order = np.argsort(keys)
    same = np.flatnonzero(np.diff(keys[order]) == 0)
    twice = np.zeros(len(keys), bool)
    twice[order[same]] = True
    twice[order[same + 1]] = True
    return among[twice]


def covered(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in the k-word windows that begin at first (ascending, different)."""
    depth = np.zeros(n + 1, np.int32)
    depth[first] += 1
    depth[first + k] -= 1
    return np.cumsum(depth[:-1]) > 0


def measure(texts: list[bytes | None], rules: Rules, b: K.Buffer | None = None) -> dict[str, np.ndarray]:
    """All measures and verdicts of texts; b: their buffer, where it is at hand."""
    b = K.read(texts) if b is None else b
    doc = b.doc_of
    text_byte = ~K.SPACE[b.raw]
    lead = (b.raw & 0xC0) != 0x80
    points = np.zeros(len(b.raw) + 1, np.int64)
    np.cumsum(text_byte & lead, out=points[1:])
    per_word = points[b.ends] - points[b.starts]
    out = {
        "n_words": np.diff(b.word_at),
        "word_chars": points[b.byte_at[1:]] - points[b.byte_at[:-1]],
        "n_symbols": K.total(SYMBOLS[b.raw], b.byte_at),
    }
    stops = np.flatnonzero(b.raw == 0x0A)
    begins = np.concatenate([[0], stops[:-1] + 1])
    chars = points[stops] - points[begins]
    has = chars > 0
    begins, stops, chars = begins[has], stops[has], chars[has]
    line_doc = np.searchsorted(b.byte_at, begins, "right") - 1
    _, firsts = np.unique(K.within(line_doc, K.ranges(b.state, begins, stops)), return_index=True)
    repeat = np.ones(len(begins), bool)
    repeat[firsts] = False
    out["n_dup_lines"] = np.bincount(line_doc[repeat], minlength=len(texts))
    out["dup_line_chars"] = np.bincount(line_doc[repeat], chars[repeat], minlength=len(texts)).astype(np.int64)
    state = K.prefix(b.words)
    inside, among = {}, None
    for k in sorted({rules.window, *rules.lengths}):
        among = repeated(b, doc, k, state, among)
        inside[k] = covered(among, k, len(b.words))
    out["n_repeat_words"] = K.total(inside[rules.window], b.word_at)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_percent * out["n_words"])
    size = np.maximum(out["word_chars"], 1)
    failed = out["base_failed"] | (out["dup_line_chars"] > rules.max_dup_line_chars * size) | (out["n_symbols"] > rules.max_symbols * size)
    worst = np.zeros(len(texts), np.int64)
    for k, limit in zip(rules.lengths, rules.max_repeat_chars):
        chars = K.total(np.where(inside[k], per_word, 0), b.word_at)
        failed |= chars > limit * size
        worst = np.maximum(worst, chars)
    out["repeat_chars"] = worst
    out["kept"] = ~failed
    return out


def quality_rules(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its measures, base_failed, and kept (the verdict).

    repeat_chars is the largest of the n-gram coverages, in code points.
    """
    rules = rules or Rules()

    def judge(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["id"].cast(pa.int64())} | measure(K.texts_of(batch, "text"), rules)

    return K.map_texts(docs, judge, SCHEMA, id_col, text_col)


def keep_good(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the rules reject, with all their columns; one pass, no join."""
    rules = rules or Rules()
    names = docs.columns
    if len(set(names)) < len(names):
        raise ValueError("columns must have different names")
    at = names.index(text_col)

    def run(batches):
        for batch in K.pieces(batches, text_col):
            good = measure(batch.column(at).cast(pa.binary()).to_pylist(), rules)["kept"]
            yield batch.filter(pa.array(good))
        K.release()

    return K.bound_batches(docs).mapInArrow(run, docs.schema)
