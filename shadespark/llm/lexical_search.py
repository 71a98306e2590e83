"""Ranked lexical search with bag deduplication.

Texts shrink to the terms that some item holds. Documents of the same term counts and the same length
class score alike for every item, so each such class is scored once and its members, in order of
doc_id, take the score:

1. One pass over the texts gives each document its number of terms and its bag: the 64-bit hashes of the
   items' terms in it, with their counts, in order. The vocabulary of the items is broadcast if it has
   at most VOCABULARY terms; beyond that, documents send all their terms and keep those that meet it.
2. The corpus statistics (documents, terms, document frequencies) come from the bags.
3. Bags are hashed, and documents whose hash, length class and whole bag are equal are a class. A window
   with a rank limit keeps the k smallest doc_ids of each class: no task sees a class whole, and an item
   can show no other member.
4. Classes meet the items' terms by term, scores are summed by class and item, and the k best classes of
   each item give their members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Terms of a vocabulary, and rows of (term, item), that are broadcast at most: 8 and about 24 bytes each.
VOCABULARY, POSTINGS = 2_000_000, 1_000_000
#: Letters and digits of ASCII, and all other characters' bytes.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_BAG = pa.list_(pa.struct([("h", pa.int64()), ("tf", pa.int32())]))


def bags(rows: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """rows: id, text -> id, n (terms with repeats), bag array<struct<h, tf>> by ascending hash: of all terms, or of those whose hash is in known (ascending)."""
    spark = rows.sparkSession
    common.bounded_batches(spark)
    held = None if known is None else spark.sparkContext.broadcast(known)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if held is None else held.value
        for b in batches:
            n, found = np.zeros(b.num_rows, np.int64), []
            for i, j, data, at in common.steps(b.column(1), IN_TERM):
                start, end, row = common.word_bounds(data, at, IN_TERM)
                h = common.word_hashes(data, start, end, lower=True).view(np.int64)
                n[i:j] += np.bincount(row, minlength=j - i)
                if wanted is not None:
                    where = np.searchsorted(wanted, h)
                    hit = np.flatnonzero(wanted[np.minimum(where, len(wanted) - 1)] == h) if len(wanted) else np.empty(0, np.int64)
                    h, row = h[hit], row[hit]
                found.append(_counted(row + i, h, np.ones(len(h), np.int64)))
            row, h, tf = _counted(*(np.concatenate(x) for x in zip(*found))) if found else (np.empty(0, np.int64),) * 3
            at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b.num_rows)))).astype(np.int32)
            terms = pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(tf.astype(np.int32))], fields=list(_BAG.value_type))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(at), terms, type=_BAG)], ["id", "n", "bag"])

    return rows.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "id long, n long, bag array<struct<h: long, tf: int>>")


def _counted(row: np.ndarray, h: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of tf by row and hash, in that order."""
    order = np.lexsort((h, row))
    row, h, tf = row[order], h[order], tf[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])))[: len(row)]
    return row[first], h[first], np.add.reduceat(tf, first) if len(first) else tf


def _within(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """bags of docs, of the terms in vocabulary (h, distinct)."""
    if vocabulary.count() <= VOCABULARY:
        known = np.sort(np.array([r["h"] for r in vocabulary.collect()], np.int64))
        return common.written(bags(docs, known), "search-bags")
    whole = common.written(bags(docs).withColumn("row", F.monotonically_increasing_id()), "search-terms")
    some = whole.select("row", F.inline("bag")).join(vocabulary, "h", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("h", "tf"))).alias("some"))
    bag = F.coalesce("some", F.array().cast("array<struct<h: bigint, tf: int>>")).alias("bag")
    return common.written(whole.drop("bag").join(some, "row", "left").select("id", "n", bag), "search-bags")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of the highest score above 0 for each item, equal scores by ascending doc_id.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Terms are the maximal runs of ASCII letters,
    digits and characters beyond ASCII, with A-Z lower-cased; null and empty texts have none. Terms are told apart by
    64-bit hashes. Rows without doc_id or item_id take no part. Rows that repeat a doc_id are documents of their own,
    and each may be returned; rows that repeat an item_id are one item with the terms of all. Empty tables give no rows.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    asked = bags(items.where("item_id is not null").select(F.col("item_id").alias("id"), "text"))
    asked = common.written(asked.select(F.col("id").alias("item_id"), F.inline("bag")).select("item_id", "h").distinct(), "search-items")
    within = _within(docs, asked.select("h").distinct())
    total = within.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not total["terms"]:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    often = within.select(F.inline("bag")).groupBy("h").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total["docs"] + 2) / (2 * F.col("df") + 1))).cast("long")
    postings = common.written(asked.join(often, "h").select("h", "item_id", weight.alias("w")).where("w > 0"), "search-postings")

    length = (100 - 50 + F.expr(f"(50 * n * {total['docs']}L) div {total['terms']}L")).alias("m")
    alike = within.where("size(bag) > 0").select(F.col("id").alias("doc_id"), length, "bag")
    alike = alike.withColumn("bag_hash", F.xxhash64("m", "bag"))
    by_id = Window.partitionBy("bag_hash", "m", "bag").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = alike.withColumn("place", F.row_number().over(by_id)).withColumn("lead", F.first("doc_id").over(by_id)).where(F.col("place") <= k)
    members = common.written(members.select("bag_hash", "lead", "doc_id", "place", F.when(F.col("place") == 1, F.struct("m", "bag")).alias("of")), "search-classes")

    few = postings.count() <= POSTINGS
    classes = members.where("place = 1").select("bag_hash", "lead", "of").repartition("bag_hash", "lead").select("bag_hash", "lead", "of.m", F.inline("of.bag"))
    part = F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))")
    scores = classes.join(F.broadcast(postings) if few else postings, "h").groupBy("bag_hash", "lead", "item_id").agg(F.sum(part).alias("score")).where("score > 0")
    best = scores.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "lead"))).where(F.col("place") <= k).drop("place")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    shown = best.join(members.select("bag_hash", "lead", "doc_id"), ["bag_hash", "lead"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return shown.select("item_id", "rank", "doc_id", "score")
