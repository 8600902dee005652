"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

Relational plan with packed rows: documents are dealt to groups by the hash of id and text;
a group's n-grams are counted and exploded into one row per hash partition, holding
distinct n-gram hashes and counts (so a frequent n-gram is one entry a group, not one a
place). The n-gram count tables are built per hash partition from these rows and joined
back to them; each group then looks its n-grams up and sums the scores per document.
Texts, n-grams and counts are shuffled once each, and what is gathered grows with the input.

An n-gram's key is its hash partition and REST_BITS more bits of its hash. A partition holds
about as many n-grams at any size of the corpus, so two of them share a key with the same small
probability (1e-8 for an n-gram) at any size. Keys are ascending, so a row has differences, in
byte planes, compressed; of the counts only those go back that other groups add something to.

Groups and partitions are as many, of group_bytes of text or of the square root of the corpus
times spread if that is more: their product, the rows exchanged, then grows with the corpus and
not with its square. A task holds one group or one partition; at 100 TB that is 430 MB of text.

Score of word w after context c: (count(c w) - own) / (count(c) - own) where the upper
count is positive, else backoff times the score at the next lower order; at order one
(count(w) - own) / (words - own), or 1 / words where that is 0. "own" is the document's own
share of a count, so no document vouches for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K


#: Bits of a hash that are compared besides its partition.
REST_BITS = 48


@dataclass(frozen=True)
class Params:
    """order: longest n-gram. group_bytes, spread: see above. leave_out: take a document's own counts away."""

    order: int = 3
    backoff: float = 0.4
    group_bytes: int = 1 << 22
    spread: float = 43.0
    leave_out: bool = True


def packed(values: np.ndarray, size: int = 8) -> bytes:
    """The low size bytes of numbers, byte plane by byte plane: high bytes are runs, which compress."""
    return values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, :size].T.tobytes()


def unpacked(data: bytes, size: int = 8) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return out.view("<u8").reshape(-1)


def squeeze(data: bytes) -> bytes:
    """data compressed, behind its length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def ngram_keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Keys that are equal for equal hashes: partition, then REST_BITS of the hash (fewer beyond 2**16 partitions)."""
    rest = min(REST_BITS, 64 - (parts - 1).bit_length())
    part = K.mix(hashes ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(parts)
    return (part << np.uint64(rest)) | (hashes & np.uint64((1 << rest) - 1))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(min(REST_BITS, 64 - (parts - 1).bit_length()))).astype(np.int64)


def ngrams(texts: list[bytes | None], p: Params, parts: int = 1) -> tuple[K.Buffer, list[np.ndarray], np.ndarray, np.ndarray]:
    """Buffer; per order the index of each word's n-gram (-1: none) in the distinct keys; these keys, ascending; their counts.

    The n-gram of order k at word i is the one that ends there and lies in i's document.
    """
    b = K.read(texts)
    state, n = K.prefix(b.words), len(b.words)
    places, keys = [], []
    for k in range(1, p.order + 1):
        first, h = b.windows(k, state)
        places.append(first + k - 1)
        keys.append(ngram_keys(h, parts))
    distinct, inverse, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    own, at = [], 0
    for place, h in zip(places, keys):
        index = np.full(n, -1, np.int64)
        index[place] = inverse[at : at + len(h)]
        at += len(h)
        own.append(index)
    return b, own, distinct, counts


def own_counts(index: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """For each place, how often its document has the same n-gram; 0 where there is none."""
    keys = doc * (size + 1) + index + 1
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(index >= 0, counts[inverse], 0)


def log_scores(b: K.Buffer, index: list[np.ndarray], counts: np.ndarray, words: int, p: Params) -> np.ndarray:
    """Sum of log scores of each document. counts: corpus counts of the distinct n-grams."""
    doc, n = b.doc_of, len(b.words)
    size = np.diff(b.word_at)
    rest = words - (size[doc] if p.leave_out else 0)
    look = lambda i: np.where(i >= 0, counts[np.maximum(i, 0)], 0) if len(counts) else np.zeros(n, np.int64)
    net = [look(i) - (own_counts(i, doc, len(counts)) if p.leave_out else 0) for i in index]
    value = np.where(net[0] > 0, net[0], 1) / np.where(net[0] > 0, np.maximum(rest, 1), max(words, 1))
    for k in range(2, p.order + 1):
        upper, lower = net[k - 1], np.zeros(n, np.int64)
        lower[1:] = net[k - 2][:-1]  # the context: the n-gram of one word less that ends before
        has = (index[k - 1] >= 0) & (upper > 0) & (lower > 0)
        value = np.where(has, upper / np.maximum(lower, 1), np.where(index[k - 1] >= 0, p.backoff * value, value))
    return np.bincount(doc, np.log(value), minlength=len(size)) if n else np.zeros(len(size))


def lm_scores(docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, log_score (natural logarithm, summed), score (mean a word; null without words).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z as they stand. Null and empty texts have no words and log_score 0.
    Repeated rows are documents of their own (equal rows share a group). Rows of null id are scored like
    the others. Ids are whole numbers; a text id that is none is an error. An empty table gives no rows.
    """
    p = params or Params()
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "utf-8").alias("text"))
    facts = named.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))).alias("words")).first()
    words, total_bytes = int(facts["words"] or 0), int(facts["bytes"] or 0)
    groups = parts = total_bytes // max(p.group_bytes, int(p.spread * total_bytes**0.5)) + 1
    dealt = named.withColumn("grp", F.pmod(F.xxhash64(F.coalesce("id", F.lit(-1)), "text"), F.lit(groups)).cast("int"))
    texts_schema = "grp int, ids binary, known binary, lengths binary, texts binary"

    def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of some MB of text, those of one group in one row, compressed."""
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("grp").combine_chunks()
            grp = table["grp"].to_numpy()
            at = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
            ids, known = table["id"].fill_null(0).to_numpy(), table["id"].is_valid().to_numpy()
            text = table["text"].to_pylist()
            cols = [
                pa.array(grp[at[:-1]], pa.int32()),
                *(pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()) for x in (ids, known)),
                pa.array([np.array([len(t) for t in text[a:b]], np.int64).tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                pa.array([squeeze(b"".join(text[a:b])) for a, b in zip(at, at[1:])], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["grp", "ids", "known", "lengths", "texts"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= 4 * K.BATCH_BYTES:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()
        K.release()

    def arranged(table: pa.Table) -> list[tuple[int | None, bytes]]:
        """Documents of a group in an order that depends on their content alone."""
        out = []
        for r in table.to_pylist():
            text, ends = expand(r["texts"]), np.cumsum(np.frombuffer(r["lengths"], np.int64)).tolist()
            known = np.frombuffer(r["known"], bool).tolist()
            out += [(i if k else None, text[a:b]) for i, k, a, b in zip(np.frombuffer(r["ids"], np.int64).tolist(), known, [0, *ends], ends)]
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    def exploded(table: pa.Table) -> pa.Table:
        grp = table["grp"][0].as_py()
        _, _, keys, counts = ngrams([t for _, t in arranged(table)], p, parts)
        at = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
        full = np.flatnonzero(np.diff(at)).tolist()
        grams = [squeeze(packed(np.diff(keys[at[q] : at[q + 1]], prepend=np.uint64(0))) + packed(counts[at[q] : at[q + 1]])) for q in full]
        K.release()
        return pa.table({"grp": pa.array([grp] * len(full), pa.int32()), "part": pa.array(full, pa.int32()), "grams": pa.array(grams, pa.binary())})

    def counted(table: pa.Table) -> pa.Table:
        """The count table of one hash partition, joined back to the rows it came from: what other groups add to each count."""
        keys, counts = [], []
        for data in table["grams"].to_pylist():
            data = expand(data)
            keys.append(np.cumsum(unpacked(data[: len(data) // 2]), dtype=np.uint64))
            counts.append(unpacked(data[len(data) // 2 :]).astype(np.int64))
        ends = np.cumsum([len(k) for k in keys])[:-1]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        flat = np.concatenate(counts)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, inverse, flat)
        rest = np.split(sums[inverse] - flat, ends)
        flags = [squeeze(np.packbits(x > 0).tobytes()) for x in rest]
        others = [f + squeeze(packed(x[x > 0])) for f, x in zip(flags, rest)]
        K.release()
        return pa.table({"grp": table["grp"], "part": table["part"], "head": pa.array([len(f) for f in flags], pa.int32()), "others": pa.array(others, pa.binary())})

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = arranged(left)
        b, index, keys, counts = ngrams([t for _, t in rows], p, parts)
        counts = counts.astype(np.int64)
        at = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
        for q, head, data in zip(right["part"].to_pylist(), right["head"].to_pylist(), right["others"].to_pylist()):
            some = np.unpackbits(np.frombuffer(expand(data[:head]), np.uint8), count=at[q + 1] - at[q]).view(bool)
            counts[at[q] : at[q + 1]][some] += unpacked(expand(data[head:])).astype(np.int64)
        total = log_scores(b, index, counts, words, p)
        size = np.diff(b.word_at)
        mean = pa.array(total / np.maximum(size, 1), pa.float64(), mask=size == 0)
        K.release()
        return pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "n_words": pa.array(size, pa.int64()), "log_score": pa.array(total), "score": mean})

    texts = K.bound_batches(dealt).select("grp", "id", "text").mapInArrow(dealt_out, texts_schema)
    grams = texts.groupBy("grp").applyInArrow(exploded, "grp int, part int, grams binary")
    others = grams.groupBy("part").applyInArrow(counted, "grp int, part int, head int, others binary")
    return texts.groupBy("grp").cogroup(others.groupBy("grp")).applyInArrow(scored, "doc_id long, n_words long, log_score double, score double")
