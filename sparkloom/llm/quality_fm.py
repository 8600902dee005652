"""Quality classifier: a factorisation machine over hashed words, structure and size.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]):
all pairwise interactions in time linear in a document's features, by the sum-of-squares
identity. Features are words hashed into slots (log counts, scaled to unit length) and
measures of the text (symbols, upper case, digits, line and word lengths, repetition, size),
and numbers that stand beside it as metadata, each in quantile-like bins so that a pair of bins can
interact; a null or non-finite number has a bin of its own.

Training takes a bounded sample of labelled rows (Params.sample, those of least hash) and runs
on the driver with numpy; scoring is one pass over the scan with the weights broadcast,
whose size Params fixes. Labels, lang, source and the id are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules as Q
from . import textkernel as K


@dataclass(frozen=True)
class Params:
    """sample: most labelled rows that training uses. slots: hashed words. rank: factors. meta: columns of numbers that are inputs."""

    sample: int = 8_000
    slots: int = 1 << 14
    rank: int = 4
    bins: int = 12
    epochs: int = 12
    batch: int = 256
    rate: float = 0.05
    l2: float = 1e-5
    seed: int = 3
    cut: float = 0.7
    meta: tuple[str, ...] = ()


#: Names of the structure measures, in order.
MEASURES = ("symbols", "upper", "digits", "marks", "word_length", "word_spread", "line_words", "dup_lines", "repeat_words", "short", "distinct", "pipes", "log_words", "bangs")


def structure(texts: list[bytes | None], b: K.Buffer) -> np.ndarray:
    """One row a text, a column a measure, all between 0 and 1 or so."""
    m = Q.measure(texts, Q.Rules(lengths=(2,), max_repeat_chars=(1.0,)), b)
    raw, at = b.raw, b.byte_at
    words = m["n_words"]
    some, chars = np.maximum(words, 1), np.maximum(m["word_chars"], 1)
    doc = b.doc_of
    length = (b.ends - b.starts).astype(np.float64)
    mean = np.bincount(doc, length, minlength=len(texts)) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, minlength=len(texts)) / some - mean**2, 0))
    count = lambda flags: K.total(flags, at)
    lines = count(raw == 0x0A)
    keys = doc[np.unique(K.within(doc, b.words), return_index=True)[1]]
    return np.stack(
        [
            m["n_symbols"] / chars,
            count((raw >= 0x41) & (raw <= 0x5A)) / chars,
            count((raw >= 0x30) & (raw <= 0x39)) / chars,
            count(np.isin(raw, np.frombuffer(b".,;:?", np.uint8))) / some,
            mean / 20,
            spread / 10,
            words / np.maximum(lines, 1) / 50,
            m["dup_line_chars"] / chars,
            m["n_repeat_words"] / some,
            np.bincount(doc, length <= 2, minlength=len(texts)) / some,
            np.bincount(keys, minlength=len(texts)) / some,
            count(raw == 0x7C) / some,
            np.log1p(words) / 12,
            count(raw == 0x21) / some,
        ],
        axis=1,
    )


def numbers(batch: pa.RecordBatch, p: Params) -> np.ndarray:
    """The metadata of a batch's rows, a column each; not a number where there is none."""
    columns = [batch[f"meta{i}"].cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for i in range(len(p.meta))]
    values = np.array(columns).reshape(len(p.meta), batch.num_rows).T
    return np.where(np.isfinite(values), values, np.nan)


def features(texts: list[bytes | None], p: Params, meta: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values and row starts of the hashed words; the measures, then the metadata (without it: not a number)."""
    meta = np.full((len(texts), len(p.meta)), np.nan) if meta is None else meta
    b = K.read(texts, lower=True)
    keys, counts = np.unique(b.doc_of * p.slots + (b.words % np.uint64(p.slots)).astype(np.int64), return_counts=True)
    doc = keys // p.slots
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(doc, value**2, minlength=len(texts)))
    return keys % p.slots, (value / np.maximum(norm[doc], 1e-12)).astype(np.float32), np.searchsorted(doc, np.arange(len(texts) + 1)), np.concatenate([structure(texts, K.read(texts)), meta], axis=1)


@dataclass(frozen=True)
class Model:
    """edges: inner borders of the bins of each measure; w0, w, v: the machine over slots, then bins."""

    params: Params
    edges: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def binned(self, measures: np.ndarray) -> np.ndarray:
        return np.stack([self.params.slots + j * self.params.bins + np.searchsorted(self.edges[j], measures[:, j], "right") for j in range(measures.shape[1])], axis=1)

    def scores(self, texts: list[bytes | None], meta: np.ndarray | None = None) -> np.ndarray:
        slots, values, at, measures = features(texts, self.params, meta)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        own = self.binned(measures)
        n = len(texts)
        linear = np.bincount(doc, self.w[slots] * values, minlength=n) + self.w[own].sum(axis=1) + self.w0
        pairs = np.zeros(n)
        for f in range(self.params.rank):
            part = self.v[slots, f] * values
            bins = self.v[own, f]
            total = np.bincount(doc, part, minlength=n) + bins.sum(axis=1)
            pairs += total**2 - np.bincount(doc, part**2, minlength=n) - (bins**2).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(linear + pairs / 2, -30, 30)))


def fit(slots: list[np.ndarray], values: list[np.ndarray], measures: np.ndarray, labels: np.ndarray, p: Params) -> Model:
    """Train by minibatch AdaGrad; classes weigh alike."""
    rng = np.random.default_rng(p.seed)
    inputs = len(MEASURES) + len(p.meta)
    size = p.slots + p.bins * inputs
    w, v = np.zeros(size), rng.normal(0, 0.01, (size, p.rank))
    if not len(labels) or labels.min() == labels.max():
        one = float(labels[0]) if len(labels) else 0.5
        return Model(p, np.zeros((inputs, p.bins - 1)), (one - 0.5) * 8, np.zeros(size), np.zeros((size, p.rank)))
    measures = np.where(np.isnan(measures).all(axis=0), 0.0, measures)
    edges = np.nanquantile(measures, np.arange(1, p.bins) / p.bins, axis=0).T.copy()
    edges[:, -1] = np.nanquantile(measures, 0.97, axis=0)
    edges[len(MEASURES) :, -1] = np.inf  # what is no number is sorted behind it, so the last bin is theirs
    model = Model(p, edges, 0.0, w, v)
    own = model.binned(measures)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    w0, g0, gw, gv = 0.0, 1e-8, np.full(size, 1e-8), np.full((size, p.rank), 1e-8)
    ones = np.ones(inputs)
    for _ in range(p.epochs):
        for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // p.batch)):
            idx = np.concatenate([np.concatenate([slots[r], own[r]]) for r in rows])
            x = np.concatenate([np.concatenate([values[r], ones]) for r in rows])
            doc = np.repeat(np.arange(len(rows)), [len(slots[r]) + inputs for r in rows])
            sums = np.stack([np.bincount(doc, v[idx, f] * x, minlength=len(rows)) for f in range(p.rank)], axis=1)
            squares = np.bincount(doc, ((v[idx] * x[:, None]) ** 2).sum(axis=1), minlength=len(rows))
            z = w0 + np.bincount(doc, w[idx] * x, minlength=len(rows)) + ((sums**2).sum(axis=1) - squares) / 2
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            g0 += error.sum() ** 2
            w0 -= p.rate * error.sum() / np.sqrt(g0)
            used, inverse = np.unique(idx, return_inverse=True)
            step = np.bincount(inverse, error[doc] * x, minlength=len(used)) + p.l2 * w[used]
            gw[used] += step**2
            w[used] -= p.rate * step / np.sqrt(gw[used])
            for f in range(p.rank):
                step = np.bincount(inverse, error[doc] * x * (sums[doc, f] - v[idx, f] * x), minlength=len(used)) + p.l2 * v[used, f]
                gv[used, f] += step**2
                v[used, f] -= p.rate * step / np.sqrt(gv[used, f]) / 4
    return Model(p, edges, w0, w, v)


def train(docs: DataFrame, labels: DataFrame, params: Params | None = None, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on documents whose label is 0 or 1 and whose id meets where, at most Params.sample of them; of an id's different labels the smaller counts."""
    p = params or Params()
    chosen = labels.where(F.col(label_col).isin(0, 1) & (F.lit(True) if where is None else where)).select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label"))
    chosen = chosen.groupBy("__id").agg(F.min("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(p.sample)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").cast("double").alias(f"meta{i}") for i, c in enumerate(p.meta))).join(chosen, F.col("id") == F.col("__id"))
    made = K.map_texts(rows, lambda b: _packed(b, p), "label int, slots binary, vals binary, measures binary", "id", "text", extra={"label": "__label"} | {f"meta{i}": f"meta{i}" for i in range(len(p.meta))}).toArrow()
    unpack = lambda name, kind: [np.frombuffer(x, kind) for x in made[name].to_pylist()]
    slots, values, measures, target = unpack("slots", np.int32), unpack("vals", np.float32), unpack("measures", np.float64), made["label"].to_numpy()
    order = sorted(range(len(target)), key=lambda i: (measures[i].tobytes(), slots[i].tobytes(), values[i].tobytes(), target[i]))  # so that the result does not depend on how rows arrive
    return fit([slots[i] for i in order], [values[i] for i in order], np.array([measures[i] for i in order]).reshape(-1, len(MEASURES) + len(p.meta)), target[order].astype(np.float64), p)


def _packed(batch: pa.RecordBatch, p: Params) -> dict:
    slots, values, at, measures = features(K.texts_of(batch, "text"), p, numbers(batch, p))
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
    return {"label": batch["label"], "slots": cut(slots.astype(np.int32)), "vals": cut(values), "measures": pa.array([x.tobytes() for x in measures], pa.binary())}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, score (0 to 1), predicted (1 if score >= cut). Null and empty texts are scored as texts without words; repeated rows alike.

    Ids are whole numbers; a text id that is none is an error. An empty table gives no rows. The columns of
    Params.meta must be there; what is no number in them counts as missing.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        found = held.value.scores(K.texts_of(batch, "text"), numbers(batch, held.value.params))
        return {"doc_id": batch["id"].cast(pa.int64()), "score": found, "predicted": (found >= held.value.params.cut).astype(np.int32)}

    return K.map_texts(docs, run, "doc_id long, score double, predicted int", id_col, text_col, extra={f"meta{i}": c for i, c in enumerate(model.params.meta)})
