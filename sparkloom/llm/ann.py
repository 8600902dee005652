"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of several full-dimensional
codebooks. Codebooks are trained on residuals of a bounded sample; vectors are encoded by
beam search over all codebooks; the norm of every approximation is stored. A query's
squared distance to an approximation is |q|^2 - 2 * sum of table entries + stored norm,
where the tables hold the query's products with all codewords. The best approximations
are compared by exact distance on the original vectors, which bounds the k-th distance;
then so is every other vector whose approximate distance, less the stored length of what
its approximation leaves, does not exceed that bound. By the triangle inequality no nearer
vector is left out, so the result is exact however many vectors are close to a query.

Plan: equal vectors fall together (each keeps its k + 1 smallest ids, by a window whose
limit is pushed below the shuffle); distinct vectors are encoded where they are and
packed in blocks with their codes, which stay where they are. Queries come to them in rounds,
each a broadcast of about QUERY_BYTES; a task lets its blocks stream past the round's queries, holds
the k + 1 nearest so far and returns as many per query. Tasks are TASKS per core of the session at most,
so what is shuffled grows with the queries and not with queries times vectors. Broadcasts are the
codebooks, whose size Params fixes, and one round of queries. Vectors of each length are searched by themselves.

Codes are made of vectors divided by the largest component of the sample, so that any magnitude
fits single precision; bounds, norms and distances are in double precision. Distances that
overflow it are infinite and ranked by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkernel import bound_batches, checkpoint


@dataclass(frozen=True)
class Params:
    """sample: most vectors that training looks at; rerank: candidates per query and block that are compared exactly to set its bound."""

    codebooks: int = 16
    codewords: int = 256
    beam: int = 4
    sample: int = 16_384
    rounds: int = 8
    rerank: int = 500
    code_block: int = 16_384
    query_block: int = 256
    seed: int = 11


def nearest_codewords(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (((book**2).sum(1) / 2)[None, :] - x @ book.T).argmin(axis=1)


def train(sample: np.ndarray, p: Params) -> np.ndarray:
    """Codebooks (codebooks, codewords, dimensions): k-means on what the earlier ones leave."""
    rng = np.random.default_rng(p.seed)
    books = np.zeros((p.codebooks, p.codewords, sample.shape[1]), np.float32)
    rest = sample.astype(np.float32).copy()
    for m in range(p.codebooks if len(sample) else 0):
        book = rest[rng.choice(len(rest), p.codewords, replace=len(rest) < p.codewords)].copy()
        for _ in range(p.rounds):
            own = nearest_codewords(rest, book)
            counts = np.bincount(own, minlength=p.codewords)
            sums = np.zeros_like(book)
            np.add.at(sums, own, rest)
            used = counts > 0
            book[used] = sums[used] / counts[used, None]
            book[~used] = rest[rng.integers(0, len(rest), (~used).sum())]
        books[m] = book
        rest -= book[nearest_codewords(rest, book)]
    return books


#: Components beyond this many times the sample's largest are encoded as if they were that large.
CLIP = 1e15


def encode(x: np.ndarray, books: np.ndarray, beam: int, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (uint8), squared norms of the approximations and lengths of what they leave, by beam search over the codebooks.

    books are of vectors divided by scale; norms and lengths are of x as it is.
    """
    n, (m_books, words, dims) = len(x), books.shape
    codes = np.zeros((n, 1, m_books), np.uint8)
    rest = np.clip(x / scale, -CLIP, CLIP).astype(np.float32)[:, None, :]
    for m in range(m_books):
        cost = (rest**2).sum(-1)[:, :, None] - 2 * rest @ books[m].T + (books[m] ** 2).sum(1)[None, None, :]
        width = min(beam, cost.shape[1] * words)
        flat = cost.reshape(n, -1)
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        parent, word = best // words, best % words
        codes = np.take_along_axis(codes, parent[:, :, None], axis=1)
        codes[:, :, m] = word
        rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - books[m][word]
    pick = (rest**2).sum(-1).argmin(axis=1)
    codes = codes[np.arange(n), pick]
    approx = np.zeros(x.shape)
    for m in range(m_books):
        approx += books[m][codes[:, m]]
    approx *= scale
    with np.errstate(over="ignore"):
        return codes, (approx**2).sum(1), np.sqrt(((x - approx) ** 2).sum(1))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the columns of x from q, summed in the order of the components."""
    total = np.zeros(x.shape[1])
    for row, v in zip(x, q):
        total += (row - v) ** 2
    return np.sqrt(total)


#: Share by which rounding may raise a bound (double precision leaves far less).
SLACK = 1e-9


def closest(q: np.ndarray, table: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, left: np.ndarray, x: np.ndarray, bound: float, take: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the nearest columns of x to q, by distance, then id: at most most of them, none that is surely beyond bound."""
    square = (q**2).sum()
    near = square - 2 * table[codes].sum(axis=1) + norms
    if len(ids) > take:
        first = np.sort(exact(x[:, np.argpartition(near, take - 1)[:take]], q))
        bound = min(bound, first[most - 1]) if take >= most else bound
    least = np.sqrt(np.maximum(near - SLACK * (square + norms), 0)) - left * (1 + SLACK)
    pick = np.flatnonzero(~(least > bound * (1 + SLACK)))  # what is no number is compared
    score = exact(x[:, pick], q)
    best = np.lexsort((ids[pick], score))[:most]
    return score[best], ids[pick][best]


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not zero."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda v: F.coalesce(finite(v), F.lit(False))) & F.exists(vector, lambda v: F.coalesce(v != 0, F.lit(False)))


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


#: Bytes of vectors in a block of codes, and of queries in a round; tasks of a search per core.
BLOCK_BYTES, QUERY_BYTES, TASKS = 16 << 20, 8 << 20, 2
_BLOCK = ["ids", "codes", "norms", "rests", "vectors"]
_ANSWER = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: Column, k: int = 10, params: Params | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest other rows, exactly, of each row for which queries holds: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Nearest first, ties to the smaller id; all other rows of the query's length where there are at most k.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows of
    null id. Rows that repeat an id count as one (its first vector, by value). A table without queries or
    vectors gives no rows.
    """
    p = params or Params()
    chosen = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(F.col(f"`{vec_col}`"), lambda v: F.when(v == 0, 0.0).otherwise(v.cast("double"))).alias("v"), queries.alias("is_query")).where(F.col("id").isNotNull() & usable(F.col("v")))
    chosen = checkpoint(chosen.groupBy("id").agg(F.min("v").alias("v"), F.max(F.coalesce("is_query", F.lit(False))).alias("is_query")))
    lengths = chosen.groupBy(F.size("v").alias("dims")).agg(F.sum(F.col("is_query").cast("long")).alias("asked")).where("asked > 0").collect()
    out = vectors.sparkSession.createDataFrame([], _ANSWER)
    for r in sorted(lengths):
        out = out.union(_search(chosen.where(F.size("v") == r["dims"]), r["dims"], r["asked"], k, p))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of about so many vectors, from whatever pieces of blocks come."""
    held, count = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            count += len(row[0]) // 8
            if count >= rows:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(x)], pa.binary()) for x in zip(*held)], _BLOCK)
                held, count = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(x)], pa.binary()) for x in zip(*held)], _BLOCK)


def _search(chosen: DataFrame, dims: int, asked: int, k: int, p: Params) -> DataFrame:
    """nearest() among vectors (id, v, is_query) of one length; asked: how many queries there are."""
    context = chosen.sparkSession.sparkContext
    sample = matrix(chosen.select("v").orderBy(F.xxhash64("id"), "id").limit(p.sample).toArrow()["v"].combine_chunks(), dims)
    scale = float(np.abs(sample).max())
    books = context.broadcast(train((sample / scale).astype(np.float32), p))
    # equal vectors: the first stands for the class, the k + 1 smallest ids can be answers
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    ranked = chosen.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).withColumn("rep", F.first("id").over(same))
    ranked = checkpoint(ranked.select("id", "rep", "place", "v"))
    block_rows = max(1, min(p.code_block, BLOCK_BYTES // (8 * dims)))
    block_schema = ", ".join(f"{c} binary" for c in _BLOCK)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = matrix(part["v"], dims)
                row = (part["id"].to_numpy(), *encode(x, books.value, p.beam, scale), x)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in row], _BLOCK)

    coded_parts = checkpoint(ranked.where("place = 1").select("id", "v").mapInArrow(coded, block_schema))
    size = coded_parts.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 0
    tasks = min(int(size // block_rows) + 1, TASKS * context.defaultParallelism)
    code_blocks = checkpoint(bound_batches(coded_parts.coalesce(int(size // block_rows) + 1)).mapInArrow(lambda batches: _blocks(batches, block_rows), block_schema)).coalesce(tasks)
    rounds = -(-asked * dims * 8 // QUERY_BYTES)
    found = None
    for n in range(rounds):
        given = chosen.where("is_query").where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == n).select("id", "v").orderBy("id").toArrow().combine_chunks()  # about QUERY_BYTES
        if not given.num_rows:
            continue
        part = code_blocks.mapInArrow(_searcher(books, scale, context.broadcast((given["id"].to_numpy(), matrix(given["v"].combine_chunks(), dims))), dims, k, p), "query_id long, rep long, score double")
        part = part if rounds == 1 else checkpoint(part)
        found = part if found is None else found.union(part)
    # a query's own class may hold no other row: k + 1 classes hold its k nearest rows
    by_rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.join(ranked.select("rep", F.col("id").alias("vec_id")), "rep")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(by_rank))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _searcher(books, scale: float, asked, dims: int, k: int, p: Params):
    """The k + 1 nearest of a task's blocks for each query of a round: codes stream by, only the nearest so far are held."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = books.value.reshape(-1, dims).astype(np.float64) * scale
        offsets = np.arange(p.codebooks) * p.codewords
        ids, q = asked.value
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                r = dict(zip(_BLOCK, row))
                known, norms, left = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["norms"]), np.frombuffer(r["rests"])
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(known), p.codebooks) + offsets
                x = np.ascontiguousarray(np.frombuffer(r["vectors"]).reshape(-1, dims).T)
                for at in range(0, len(q), p.query_block):
                    with np.errstate(over="ignore", invalid="ignore"):
                        tables = q[at : at + p.query_block] @ flat.T
                        for i, table in enumerate(tables, at):
                            score, near = best[i]
                            more, others = closest(q[i], table, known, codes, norms, left, x, score[k] if len(score) > k else np.inf, max(p.rerank, k + 1), k + 1)
                            score, near = np.concatenate([score, more]), np.concatenate([near, others])
                            order = np.lexsort((near, score))[: k + 1]
                            best[i] = score[order], near[order]
        ends = [len(near) for _, near in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ends)), pa.array(np.concatenate([near for _, near in best])), pa.array(np.concatenate([score for score, _ in best]))], ["query_id", "rep", "score"])

    return searched
