"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit, a binary logistic classifier over hashed byte n-grams
predicts that bit; decoding sums the logistic loss of the bits against each codeword, takes the
codeword of the smallest loss, and flags texts whose two best codewords are close.
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
from .training import own_label_sample

#: Documents of each language in the fitting sample at most, and buckets of hashed n-grams.
SAMPLE, BUCKETS = 1200, 4096
ORDERS = (1, 2, 3)
AMBIGUOUS = 0.75


def code_matrix(n: int) -> np.ndarray:
    """Codewords of n classes as rows of +1 and -1: all distinct splits up to 6 classes, else random ones far apart."""
    if n == 1:
        return np.ones((1, 1), int)
    if n <= 6:
        return np.array([[1 if (c >> i) & 1 else -1 for c in range(1 << (n - 1), (1 << n) - 1)] for i in range(n)]).reshape(n, -1)
    rng, best = np.random.default_rng(n), None
    for _ in range(50 if n <= 200 else 1):  # random words of this length are far apart anyway
        m = rng.choice([-1, 1], (n, 15 * int(np.ceil(np.log2(n)))))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        apart = (m.shape[1] - m @ m.T + 2 * m.shape[1] * np.eye(n, dtype=int)).min() // 2
        if best is None or apart > best[0]:
            best = apart, m
    return best[1]


def ngram_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of hashed n-gram counts of each row, of length 1. N-grams do not cross rows; A-Z count as a-z."""
    rows = len(at) - 1
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    low[(data < 65) | (data > 90) & (data < 97) | (data > 122) & (data < 128)] = 32
    doc = np.repeat(np.arange(rows), np.diff(at))
    out = np.zeros(rows * BUCKETS)
    code = np.zeros(len(low), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(low) < n:
            break
        code = code[: len(low) - n + 1] * np.uint32(257) + low[n - 1 :].astype(np.uint32) + np.uint32(1)
        if n in ORDERS:
            slot = (code * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
            inside = doc[: len(code)] == doc[n - 1 :]
            out += np.bincount((doc[: len(code)] * BUCKETS + slot)[inside], minlength=rows * BUCKETS)
    out = np.sqrt(out.reshape(rows, BUCKETS)).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its share of the decoding weight, and whether it is ambiguous."""
        margin = x @ self.weights + self.bias
        loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code[None], -30, 30))).sum(axis=2)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = share[np.arange(len(x)), best]
        return best, top, top < AMBIGUOUS


def fit_language(docs: DataFrame, parts: int = 5, held_out: int = 0, sample: int = SAMPLE) -> LanguageModel:
    """Learn every language of the rows from at most `sample` documents of each; held-out rows and rows without lang are never read."""
    common.bounded_batches(docs.sparkSession)
    rows = own_label_sample(docs.select("doc_id", "text", F.col("lang").cast("string").alias("label")), sample, parts, held_out)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in common.slices(b.column(0)):
                x = ngram_features(data, at).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), common.binary_rows(x, np.arange(j - i + 1) * BUCKETS)], ["label", "x"])

    got = rows.mapInArrow(features, "label string, x binary").orderBy("label", F.xxhash64("x")).toArrow()
    names = got["label"].to_pylist()
    languages = sorted(set(names))
    if not languages:
        return LanguageModel([], np.zeros((0, 0)), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    data, at = common.text_buffer(got["x"])
    x = data[at[0] : at[-1]].view(np.float16).reshape(-1, BUCKETS).astype(np.float32)
    code, of = code_matrix(len(languages)), np.searchsorted(languages, names)
    y = code[of].astype(np.float32)
    weight = (len(names) / len(languages) / np.bincount(of)[of]).astype(np.float32)[:, None]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(150):  # gradient steps with momentum on the mean logistic loss
        g = -y * weight / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        speed_w = 0.9 * speed_w - 4.0 * (x.T @ g + 1e-5 * w)
        speed_b = 0.9 * speed_b - 4.0 * g.sum(axis=0)
        w, b = w + speed_w, b + speed_b
    return LanguageModel(languages, code, w, b)


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous of every whole text.

    Null texts and texts without a letter are `und` with score 0, and so is every text if nothing was
    learned. Every row of docs gives a row, rows without doc_id and repeated ones too. Columns other
    than doc_id and text are not read.
    """
    common.bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters = b.column(2).to_numpy(zero_copy_only=False)
            for i, j, data, at in common.slices(b.column(1), common.SLICE_BYTES // 2):
                pred, score, close = ["und"] * (j - i), np.zeros(j - i), np.zeros(j - i, bool)
                for a in range(0, j - i, 512):  # a slice may hold many tiny texts
                    z = min(a + 512, j - i)
                    if model.languages:
                        best, top, near = model.decode(ngram_features(data[at[a] : at[z]], at[a : z + 1] - at[a]))
                        ok = letters[i + a : i + z].astype(bool)
                        pred[a:z] = [model.languages[k] if o else "und" for k, o in zip(best, ok)]
                        score[a:z], close[a:z] = np.where(ok, top, 0), near & ok
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(pred), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(of, "doc_id long, lang_pred string, score double, ambiguous boolean")
