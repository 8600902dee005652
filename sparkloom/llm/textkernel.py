"""Vectorised text kernels shared by the document operators.

Texts of many documents are laid end to end in one byte buffer; words, lines and
word windows are then found and hashed with numpy for the whole buffer at once, so
that the cost of a document is the cost of its bytes and not of Python calls.

Hashes are 64 bits: a polynomial over random byte values, finished by a mixing
step. Equal strings have equal hashes; different ones collide with probability
about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one buffer takes (a longer single text makes a longer buffer).
BUFFER_BYTES = 1 << 20
#: Bytes of rows that Spark puts in one Arrow batch for Python; its default would be held several times over per task.
BATCH_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them (kept between calls)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers: the state from which any range is hashed."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values))[: len(values)], out=out[1:])
    return out


def ranges(state: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) ranges of the sequence behind a prefix() state."""
    raw = (state[ends] - state[starts]) * powers(_INVERSE, len(state))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Buffer:
    """Words of some texts: doc d owns words word_at[d]:word_at[d+1] and bytes byte_at[d]:byte_at[d+1]-1."""

    raw: np.ndarray
    byte_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_at: np.ndarray
    state: np.ndarray
    words: np.ndarray

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.word_at) - 1), np.diff(self.word_at))

    def windows(self, k: int, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of k words that lie within one document."""
        n = len(self.words)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc = self.doc_of
        first = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        return first, ranges(prefix(self.words) if state is None else state, first, first + k)


def read(texts: list[bytes | None], lower: bool = False) -> Buffer:
    """Lay texts (UTF-8, None: empty) in a buffer and find their words, [^\\x20\\x09-\\x0D]+."""
    texts = [t or b"" for t in texts]
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    byte_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=byte_at[1:])
    space = SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word_at = np.searchsorted(starts, byte_at)
    state = prefix(_BYTE[raw])
    return Buffer(raw, byte_at, starts, ends, word_at, state, ranges(state, starts, ends))


def within(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys that are equal for equal hashes of one document only."""
    return mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(0x51ED270B)))


def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags over each [at[d], at[d+1])."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BUFFER_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about limit bytes of text (or a single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(batch[column]).to_pylist()], np.int64)
        part = (np.cumsum(sizes + 64) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def bound_batches(df: DataFrame) -> DataFrame:
    """df, after its session's limit on an Arrow batch is lowered to BATCH_BYTES (a lower one stays)."""
    context, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = context.conf.get(key)
    if not held.removesuffix("b").isdigit() or int(held.removesuffix("b")) > BATCH_BYTES:
        context.conf.set(key, f"{BATCH_BYTES}b")
    return df


def release() -> None:
    """Give memory that a finished task has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch[column].cast(pa.binary()).to_pylist()


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, id_col: str, text_col: str, limit: int = BUFFER_BYTES, extra: dict | None = None) -> DataFrame:
    """Apply fn to bounded slices of (id, text, extra columns), named "id" and "text" inside; fn returns columns by name.

    Only these columns are read, so other columns of df cannot clash with the result's.
    """
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", limit):
            out = fn(piece)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)
        release()

    chosen = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(n) for n, c in (extra or {}).items())]
    return bound_batches(df).select(*chosen).mapInArrow(run, schema)


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder that all executors share and read it from there.

    The folder comes from the session's spark.checkpoint.dir. Where that is unset, as in tests, a folder of this machine
    is set if Spark runs on this machine alone; else it is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not on_one_machine(df.sparkSession):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove shuffle and checkpoint files of steps that nothing refers to any more.

    It does so when the driver's garbage is collected, which many short steps alone do not bring about.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
