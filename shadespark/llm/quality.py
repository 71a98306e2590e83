"""Quality by random-indexing word vectors and a two-layer network.

Words hash to slots, and every slot has a sparse random index vector. A slot's context vector sums the
index vectors of its neighbours over all documents. A document is the pool of its words' context
vectors, of the products of neighbouring ones (repetition), and of index vectors of its character
trigrams (words never seen). A network of two layers in numpy gives logits, which a temperature fitted
on documents apart from its training turns into calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U
from .training import labelled_sample

#: Documents of each label in the fitting sample at most; slots of words, slots of trigrams, size of vectors.
SAMPLE, SLOTS, TRIGRAMS, SIZE = 3000, 1 << 14, 4096, 32
REACH, HIDDEN = 2, 32


def _index(slots: int, seed: int) -> np.ndarray:
    """Sparse ternary index vectors: 4 of SIZE entries are +1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((slots, SIZE), np.float32)
    for _ in range(4):
        out[np.arange(slots), rng.integers(0, SIZE, slots)] = rng.choice([-1, 1], slots)
    return out


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = common.word_bounds(data, at)
    return (common.word_hashes(data, start, end, lower=False) % U(SLOTS)).astype(np.int64), row


def _sum_rows(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros((rows, values.shape[1]), np.float32)
    if len(row):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


def context_sums(data: np.ndarray, at: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors for each slot; whole numbers."""
    slot, row = _words(data, at)
    out = np.zeros((SLOTS, SIZE), np.int64)
    around = np.zeros((len(slot), SIZE), np.float32)
    for d in range(1, min(REACH, len(slot) - 1) + 1):
        same = (row[d:] == row[:-d])[:, None]
        around[:-d] += index[slot[d:]] * same
        around[d:] += index[slot[:-d]] * same
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    if len(slot):
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        out[slot[first]] = np.add.reduceat(around[order].astype(np.int64), first, axis=0)
    return out


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The context vectors of all slots, of length 1, summed over all texts: by partition, then by slot."""
    names = [f"v{k}" for k in range(SIZE)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = _index(SLOTS, 1), np.zeros((SLOTS, SIZE), np.int64)
        for b in batches:
            for _, _, data, at in common.slices(b.column(0), common.SLICE_BYTES // 2):
                total += context_sums(data, at, index)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(SIZE))], ["slot", *names])

    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(sums, ", ".join(["slot long", *(f"{n} long" for n in names)]))
    got = partial.groupBy("slot").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    context = np.zeros((SLOTS, SIZE), np.float32)
    if got.num_rows:
        context[common.int64(got["slot"])] = np.stack([common.int64(got[n]) for n in names], axis=1)
    return context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)


@dataclass
class QualityModel:
    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def pooled(data: np.ndarray, at: np.ndarray, context: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
    """The document vectors of joined texts."""
    rows = len(at) - 1
    slot, row = _words(data, at)
    n = np.maximum(np.bincount(row, minlength=rows), 1)[:, None]
    v = context[slot]
    parts = [_sum_rows(v, row, rows) / n]
    same = row[1:] == row[:-1]
    parts.append(_sum_rows((v[1:] * v[:-1])[same], row[1:][same], rows) / n)
    doc = np.repeat(np.arange(rows), np.diff(at))
    if len(data) >= 3:
        code = (data[:-2].astype(np.uint32) * np.uint32(65537) + data[1:-1].astype(np.uint32) * np.uint32(257) + data[2:]) * np.uint32(2654435761) >> np.uint32(20)
        inside = doc[:-2] == doc[2:]
        count = np.bincount((doc[:-2] * TRIGRAMS + code)[inside], minlength=rows * TRIGRAMS).reshape(rows, TRIGRAMS)
        parts.append((count @ trigrams / np.maximum(count.sum(axis=1, keepdims=True), 1)).astype(np.float32))
        parts.append((np.sqrt(count) @ trigrams / np.maximum(np.sqrt(count).sum(axis=1, keepdims=True), 1)).astype(np.float32))
    else:
        parts += [np.zeros((rows, SIZE), np.float32)] * 2
    return np.hstack(parts)


def _features(docs: DataFrame, context: np.ndarray, finish) -> DataFrame:
    trigram_seed = 3

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams = _index(TRIGRAMS, trigram_seed)
        for b in batches:
            for i, j, data, at in common.slices(b.column(1), common.SLICE_BYTES // 2):
                for a in range(0, j - i, 512):
                    z = min(a + 512, j - i)
                    x = pooled(data[at[a] : at[z]], at[a : z + 1] - at[a], context, trigrams)
                    yield finish(b.slice(i + a, z - a), x)

    return of


def fit_quality(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2, sample: int = SAMPLE) -> QualityModel:
    """Learn labels from at most `sample` documents of each, never from held-out rows; word vectors come from the texts of all documents."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = labelled_sample(docs, labels.select("doc_id", F.col("quality").cast("int").alias("label")), sample, parts, held_out)
    rows = common.written(rows.withColumn("check", (F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(5)) == 0).cast("int")), "quality-sample")
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts != held_out)
    share = known.agg(F.avg(F.col("quality").cast("double")).alias("p")).first()["p"]

    context = context_vectors(docs)

    def finish(b: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(2), b.column(3), common.binary_rows(x.astype(np.float32), np.arange(len(x) + 1) * x.shape[1])], ["label", "check", "x"])

    got = rows.select("doc_id", "text", "label", "check").mapInArrow(_features(rows, context, finish), "label int, check int, x binary").orderBy("label", F.xxhash64("x")).collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got]).reshape(len(got), 4 * SIZE)
    y, apart = np.array([r["label"] for r in got], np.float32), np.array([r["check"] for r in got], bool)
    if not len(y) or not 0 < y[~apart].sum() < (~apart).sum():
        width = 4 * SIZE
        p = float(np.clip(share if share is not None else 0.5, 0.01, 0.99))
        return QualityModel(context, np.zeros(width, np.float32), np.ones(width, np.float32), (np.zeros((width, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), float(np.log(p / (1 - p)))), 1.0)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    mean, scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-6
    layers = _train((x[~apart] - mean) / scale, y[~apart], weight[~apart])
    model = QualityModel(context, mean, scale, layers, 1.0)
    if apart.any():
        z, t = model.logits(x[apart]), y[apart] * 2 - 1
        losses = [(float((weight[apart] * np.log1p(np.exp(np.clip(-t * z / temp, -30, 30)))).mean()), temp) for temp in np.geomspace(0.25, 8, 41)]
        model.temperature = float(min(losses)[1])
    return model


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 1500, batch: int = 256) -> tuple:
    """Adam on the weighted logistic loss, with weight decay."""
    rng = np.random.default_rng(6)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), min(batch, len(x)))
        h = np.tanh(x[at] @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[at]) * weight[at] / len(at)
        back = np.outer(g, p[2]) * (1 - h * h)
        for k, grad in enumerate((x[at].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()], np.float32))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            p[k] = p[k] - 0.005 * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= threshold) of every whole text.

    Null, empty and wordless texts pool to the zero vector and get its score. Every row of docs gives a
    row, rows without doc_id and repeated ones too. Columns other than doc_id and text are not read.
    """
    common.bounded_batches(docs.sparkSession)

    def finish(b: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        p = model.score(x).astype(np.float64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_features(rows, model.context, finish), "doc_id long, score double, predicted int")
