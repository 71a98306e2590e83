"""Suffix-array dedup: longest-previous-factor arrays find bytes that a long string earlier in the corpus covers.

Within a bucket (see `windows`) the strings are joined in document order and their suffixes sorted by
prefix doubling as far as the window. In suffix order, the previous and the next smaller position
hold the two longest earlier matches of a suffix; where one of them shares the whole window, the
suffix repeats an earlier one and its bytes go, while the first occurrence stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows
from .common import U

WINDOW = 100
KGRAM = 32


def smaller_neighbours(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each index of a suffix order, the nearest index before and after it with a smaller position (-1: none)."""

    def before(p: np.ndarray) -> np.ndarray:
        near = np.arange(-1, len(p) - 1)
        while True:
            bad = np.flatnonzero((near >= 0) & (p[near] > p))
            if not len(bad):
                return near
            near[bad] = near[near[bad]]

    after = before(place[::-1])[::-1]
    return before(place), np.where(after >= 0, len(place) - 1 - after, -1)


def later_copies(strings: list[bytes], window: int) -> list[np.ndarray]:
    """Starts in each string of windows that start earlier, in an earlier string or the same."""
    lengths = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin = windows.window_starts(lengths, window)
    begin = windows.maybe_repeated(common.byte_hashes(data), window, begin)
    if not len(begin):
        return [np.empty(0, np.int64)] * len(strings)
    key, unit = data.astype(U), 1
    while unit < 8 and unit * 2 <= window:
        key = (key << U(8 * unit)) | np.append(key[unit:], np.zeros(unit, U))
        unit *= 2
    live, rank = windows.doubled_ranks(key, unit, window, begin)
    order = np.lexsort((live, rank))
    place, rank = live[order], rank[order]
    earlier, later = smaller_neighbours(place)
    longest = np.zeros(len(place), bool)  # the longest previous factor reaches the window
    for near in (earlier, later):
        longest |= (near >= 0) & (rank[near] == rank)
    return windows.by_string(place[longest], lengths)


def unit(window: int = WINDOW, kgram: int = KGRAM) -> windows.Unit:
    return windows.Unit("suffix", window, kgram, False, later_copies)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, runs, sha, text = [], [], [], []
        for x, spans in zip(b.column(1), b.column(2).to_pylist()):
            data, at, parts = (x.as_py() or "").encode(), 0, []
            found = windows.merged((s["start"], s["stop"]) for s in spans)
            for a, z in found:
                parts.append(data[at:a])
                at = z
            kept = b"".join([*parts, data[at:]])
            removed.append(len(data) - len(kept))
            runs.append(len(found))
            sha.append(hashlib.sha256(kept).hexdigest())
            text.append(kept)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha), pa.array(text, pa.binary())], ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, window: int = WINDOW, kgram: int = KGRAM, with_bytes: bool = True) -> DataFrame:
    """Remove every byte of UTF-8 texts that a `window`-byte string starting earlier also covers.

    Earlier: smaller doc_id, or the same document and an earlier start. Strings are judged on the input.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if with_bytes,
    kept (binary; a cut may fall inside a character).

    Null and empty texts: 0 bytes. Rows without doc_id are compared with nothing and stay whole. Rows
    that repeat a doc_id are one document; if their texts differ, the one with the smallest SHA-256.
    Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    u = unit(window, kgram)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once, known, spans = windows.repeated(docs, u)
    columns = ["doc_id", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = once.repartition(shuffles, "doc_id")
    cut = source.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary").select(*columns)
    cut = cut.groupBy("doc_id").agg(F.min(F.struct(*columns[1:])).alias("c"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    copy = (F.col("doc_id") != F.col("first")) & (F.col("n") >= window)
    some = F.col("c").isNotNull()
    out = known.join(cut, "doc_id", "left").select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).when(some, F.col("c.n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(some, F.col("c.n_spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(copy, empty).when(some, F.col("c.kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("c.kept")).alias("kept")] * with_bytes),
    )
    text = F.coalesce("text", F.lit("")).cast("binary")
    if with_bytes:
        whole = once.select("doc_id", text.alias("bytes"))
        out = out.join(whole, "doc_id").withColumn("kept", F.coalesce("kept", "bytes")).drop("bytes")
    zero = F.lit(0).cast("long")
    loose = docs.where("doc_id is null").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *([text.alias("kept")] * with_bytes))
    return out.unionByName(loose)
