"""What the corpus operators share: the shared folder, Arrow text buffers, vectorised words and shingles.

Words are `[^\\x20\\x09-\\x0D]+`: runs of bytes other than space and the controls 9 to 13. UTF-8 never
uses those bytes inside a longer character, so words can be found on bytes.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on, so that its arrays stay in the caches and memory is bounded.
SLICE_BYTES = 1 << 20
#: Bytes of one Arrow batch between Spark and Python.
BATCH_BYTES = 8 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's setting that removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, U), np.ones(1, U)]
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=U) | U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes (a smaller bound of the session stays), as rows may hold very long texts; let Python workers of this host find the package."""
    bound = spark.conf.get(ARROW_BYTES)
    if not bound.isdigit() or int(bound) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master takes a temporary one, and a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shadespark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/shadespark-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the table replaces its shuffles, which would stay on disk until the driver collects garbage
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def is_held_out(parts: int, which: int):
    """crc32 of doc_id as text, modulo parts, is which; rows without doc_id are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == which, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes: first row, last row + 1, bytes, row offsets from 0. A longer row is a run of its own."""
    data, at = text_buffer(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=U)
    return _POWERS[0][:n], _POWERS[1][:n]


def pieces(data: np.ndarray, inside: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Parts of about limit bytes, cut behind a byte that is outside words (a longer word stays whole). inside: for each byte, whether words hold it."""
    begin = 0
    while len(data) - begin > limit:
        cut = begin + limit
        while cut < len(data) and inside[data[cut - 1]]:
            ahead = np.flatnonzero(~inside[data[cut : cut + limit]])
            cut = min(len(data), cut + int(ahead[0]) + 1 if len(ahead) else cut + limit)
        yield begin, cut
        begin = cut
    yield begin, len(data)


def steps(column: pa.Array, inside: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As slices, but a row of over limit bytes comes in several runs, cut as by pieces."""
    for i, j, data, at in slices(column, limit):
        if j - i > 1:
            yield i, j, data, at
        else:
            for begin, end in pieces(data, inside, limit):
                yield i, j, data[begin:end], np.array([0, end - begin])


#: Bytes of words, by byte.
IN_WORD = np.ones(256, bool)
IN_WORD[[32, *range(9, 14)]] = False


def word_bounds(data: np.ndarray, at: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, last byte + 1 and row of each word; no word crosses a row. inside: for each byte, whether words hold it."""
    n = len(data)
    if not n:
        return (np.empty(0, np.int64),) * 3
    word = (data != 32) & ((data < 9) | (data > 13)) if inside is None else inside[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = at[(at > 0) & (at < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word, of its lower-cased form (A-Z only) if lower."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def byte_hashes(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, in about 2 log2 k passes."""
    if len(h) < k:
        return np.empty(0, U)
    n, out, have, step, size = len(h) - k + 1, None, 0, h, 1
    while True:
        if k & size:
            out = step if out is None else out[: len(step) - have] * U(pow(_BASE, size, 1 << 64)) + step[have : have + len(out)]
            if have + size <= k:
                out = out[: len(h) - have - size + 1]
            have += size
        if have == k:
            return mix(out[:n])
        step = step[:-size] * U(pow(_BASE, size, 1 << 64)) + step[size:]
        size *= 2


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values."""
    size, m = 1, v
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(v) - w + 1], m[w - size : len(v) - size + 1]) if w > size else m


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles (64-bit, ascending) of every row and the row offsets into them.

    Words are lower-cased (A-Z). A row of fewer than k words has its whole sequence as its one
    shingle; a row without words has none.
    """
    rows = len(at) - 1
    start, end, row = word_bounds(data, at)
    h = word_hashes(data, start, end, lower=True)
    words = np.bincount(row, minlength=rows)
    g = kgrams(h, k)
    inside = row[: len(g)] == row[k - 1 :] if len(g) else np.empty(0, bool)
    of, value = row[: len(g)][inside], g[inside]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(words)))
        extra = np.zeros(len(short), U)
        for i, r in enumerate(short):
            for x in h[begin[r] : begin[r + 1]].tolist():
                extra[i] = (int(extra[i]) * _BASE + x + 1) % (1 << 64)
        of, value = np.concatenate((of, short)), np.concatenate((value, mix(extra)))
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    of, value = of[new], value[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows))))


def binary_rows(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of a contiguous array as an Arrow binary column; at counts items."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def int64(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
