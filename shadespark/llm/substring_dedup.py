"""Substring dedup by super-k-mer partitioning, over words.

Consecutive windows of words that share a minimiser travel as one packed string to the bucket of that
minimiser (see `windows`). A bucket numbers its words, sorts its windows by prefix doubling and counts
runs of equal ones exactly; all but the first of a run are later copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .common import U

WINDOW = 20
KGRAM = 6


def later_copies(strings: list[bytes], window: int) -> list[np.ndarray]:
    """Starts in each string of windows that start earlier, in an earlier string or the same."""
    words = [s.split(b" ") for s in strings]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(U)
    begin = windows.maybe_repeated(flat * U(0x9E3779B97F4A7C15) + U(1), window, windows.window_starts(lengths, window))
    if not len(begin):
        return [np.empty(0, np.int64)] * len(strings)
    live, rank = windows.doubled_ranks(flat, 1, window, begin)
    order = np.lexsort((live, rank))
    live, rank = live[order], rank[order]
    again = np.zeros(len(live), bool)
    again[1:] = rank[1:] == rank[:-1]
    return windows.by_string(live[again], lengths)


def unit(window: int = WINDOW, kgram: int = KGRAM) -> windows.Unit:
    return windows.Unit("substring", window, kgram, True, later_copies)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, sha, text = [], [], []
        for x, spans in zip(b.column(1), b.column(2).to_pylist()):
            words, at, parts = (x.as_py() or "").encode().split(), 0, []
            for a, z in windows.merged((s["start"], s["stop"]) for s in spans):
                parts += words[at:a]
                at = z
            parts += words[at:]
            kept = b" ".join(parts)
            removed.append(len(words) - len(parts))
            sha.append(hashlib.sha256(kept).hexdigest())
            text.append(kept.decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(sha), pa.array(text, pa.string())], ["doc_id", "n_removed", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, kgram: int = KGRAM, with_text: bool = True) -> DataFrame:
    """Remove every word that a window of `window` words starting earlier also covers.

    Earlier: smaller doc_id, or the same document and an earlier start. Windows are judged on the input.
    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) and, if
    with_text, kept: the text with its words removed. A document that loses nothing keeps its text as it is.

    Null texts have no words. Rows without doc_id are compared with nothing and stay whole. Rows that
    repeat a doc_id are one document; if their words differ, the one with the smallest SHA-256.
    Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    u = unit(window, kgram)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once, known, spans = windows.repeated(docs, u)
    columns = ["doc_id", "n_removed", "kept_sha256"] + ["kept"] * with_text
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = once.repartition(shuffles, "doc_id")
    cut = source.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_removed long, kept_sha256 string, kept string").select(*columns)
    cut = cut.groupBy("doc_id").agg(F.min(F.struct(*columns[1:])).alias("c"))
    copy = (F.col("doc_id") != F.col("first")) & (F.col("n") >= window)
    some = F.col("c").isNotNull()
    out = known.join(cut, "doc_id", "left").select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).when(some, F.col("c.n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(some, F.col("c.kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("c.kept")).alias("kept")] * with_text),
    )
    loose = windows.contents(docs.where("doc_id is null"), u)
    loose = loose.select("doc_id", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), *([F.lit(None).cast("string").alias("kept")] * with_text))
    return out.unionByName(loose)
