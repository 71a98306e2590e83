"""Bounded labelled samples: the only rows that the classifiers gather on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Rows of one fit at most, over all labels; with many labels, each has an equal share of them.
ROWS = 12_800


def _learned(df: DataFrame, parts: int, which: int) -> DataFrame:
    return df.where("doc_id is not null and label is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts != which)


def _drawn(known: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """(keys, label) of at most min(cap, ROWS / labels) keys of each label, in hash order. known: one row for each key."""
    known = common.written(known, "known-labels")
    counts = known.groupBy("label").count()
    labels = counts.count()
    if labels > ROWS:
        raise ValueError(f"{labels} labels are more than one fit of {ROWS} rows can hold")
    cap = min(cap, ROWS // max(labels, 1))
    # keys of the smallest hashes, about twice as many as are taken, so that no label's rows meet in one task
    near = F.pmod(F.xxhash64(*keys, F.lit("near")), F.lit(1 << 30)) < F.least(F.lit(2.0 * cap) / F.col("count"), F.lit(1.0)) * (1 << 30)
    order = Window.partitionBy("label").orderBy(F.xxhash64(*keys), *keys)
    return known.join(F.broadcast(counts), "label").where(near).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select(*keys, "label")


def _agreed(known: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key whose rows all have the same label; the others teach nothing."""
    return known.groupBy(*keys).agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")


def labelled_sample(docs: DataFrame, labels: DataFrame, cap: int, parts: int, which: int) -> DataFrame:
    """(doc_id, text, label) of at most cap documents of each label, in hash order of doc_id.

    labels: doc_id, label. Documents whose crc32(doc_id as text) mod parts is which are never taken, nor
    those that labels name with different labels. A label has at most ROWS / number of labels documents.
    At most ROWS ids are broadcast, so texts are not shuffled.
    """
    ids = _drawn(_agreed(_learned(labels, parts, which).select(F.col("doc_id").cast("long").alias("doc_id"), "label"), ["doc_id"]), ["doc_id"], cap)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")


def own_label_sample(rows: DataFrame, cap: int, parts: int, which: int) -> DataFrame:
    """(text, label) of at most cap rows of each label, as labelled_sample; rows: doc_id, text, label.

    A text counts once for each doc_id, and under its own label; one that a doc_id repeats with different
    labels teaches nothing, as do null texts and labels.
    """
    rows = _learned(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "label"), parts, which).where("text is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ids = _drawn(_agreed(rows.drop("text"), ["doc_id", "hash"]), ["doc_id", "hash"], cap).withColumnRenamed("label", "its_label")
    taken = rows.join(F.broadcast(ids), ["doc_id", "hash"])
    return taken.groupBy("doc_id", "hash").agg(F.min("text").alias("text"), F.min("its_label").alias("label")).select("text", "label")
