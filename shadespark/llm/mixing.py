"""Mixing sources to target weights with fixed-length blocks.

The words of each source are packed, document after document, into blocks of BLOCK words. The output
is a row of shards of SLOTS slots. For each shard the counts of slots by source are one multinomial
draw, the draws being held to the sources' totals (slots are drawn without replacement); the k-th slot of a source takes block perm(k), a
pseudorandom permutation of that source's block indexes, over again once all blocks are taken. Slots
are joined by source and index with the parts of the corpus that hold the blocks, and each part fills
its slots with words; a block that lies in several parts is put together in the end. The filled slots
are written, and the counts of words by document come from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .common import U

#: Words of a block, slots of a shard, and documents and words in one step of the running sums.
BLOCK, SLOTS, STEP, STEP_WORDS = 64, 4096, 2000, 1 << 21
#: Shards that a task draws, where there are more than cores.
TASK_SHARDS = 256
#: Sources whose table is broadcast at most; beyond it, the join shuffles.
BROADCAST_SOURCES = 100_000
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0


def _rounds(half: np.ndarray, mask: np.ndarray, seed: np.ndarray, x: np.ndarray, back: bool) -> np.ndarray:
    """Four Feistel rounds on pairs of half-words, or the same backwards."""
    left, right = x >> half, x & mask
    for r in reversed(range(4)) if back else range(4):
        if back:
            left, right = right ^ (common.mix(left * U(0x9E3779B97F4A7C15) + seed + U(r)) & mask), left
        else:
            left, right = right, left ^ (common.mix(right * U(0x9E3779B97F4A7C15) + seed + U(r)) & mask)
    return (left << half) | right


def permuted(index: np.ndarray, n: np.ndarray, seed: np.ndarray, back: bool = False) -> np.ndarray:
    """A permutation of range(n) for each seed, at index, or its inverse: Feistel rounds, repeated while the result is out of range."""
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2, 1).astype(U)
    mask, x, seed = (U(1) << half) - U(1), index.astype(U), seed.astype(U)
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _rounds(half[todo], mask[todo], seed[todo], x[todo], back)
        todo = todo[x[todo] >= n[todo].astype(U)]
    return x.astype(np.int64)


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, rank (1 first), source_size, target of each source.

    Sources in code point order, null last, take the weights in turn and share `share` times all words.
    A target stops at cap times its source's size; what is over is shared by weight among the others.
    One row a source: source counts are taken as the only bounded thing.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.array(*(F.lit(float(w)) for w in weights))
    sizes = sizes.withColumn("w", F.element_at(turn, F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    # Sources reach their limit in the order of limit / weight. With the first ones at their limits, the
    # level (words for each unit of weight) of the others is what is left over their weights.
    order = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sizes = sizes.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    below = F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.row_number().over(order).alias("n"), "level"))
    sizes = sizes.withColumn("level", F.min(below).over(everything)["level"])
    return sizes.select("source", "rank", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("w")), F.col("limit")).alias("target"))


def parts_of(rows: DataFrame) -> DataFrame:
    """rank, part, n (words), offset: words of the same source in the parts before."""
    earlier = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("rank", "part").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def place_in_source(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with `begin`: words of the same source in documents before (by part, then doc_id), by running sums in two steps."""
    within = Window.partitionBy("rank", "part").orderBy("doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(parts.select("rank", "part", "offset"), ["rank", "part"]).withColumn("begin", F.col("begin") + F.col("offset")).drop("offset")


def _seeds(rank, turn, seed: int):
    return rank * 1_000_003 + turn * 101 + seed


def _draws(sources: pd.DataFrame, seed: int, block: int):
    """Slots of shards: each shard's source counts and the block that each slot takes.

    Every source has a ticket for each of its slots, and a shard draws SLOTS of all tickets without
    replacement (by a pseudorandom permutation of them), so that its counts of tickets by source are a
    multinomial draw held to the sources' totals. A shard needs only its own draw, at any size.
    """
    rank, blocks, need, size = (sources[c].to_numpy(np.int64) for c in ("rank", "blocks", "slots", "source_size"))
    edge = np.concatenate(([0], np.cumsum(need)))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                slot = np.arange(min(SLOTS, int(edge[-1]) - int(shard) * SLOTS))
                ticket = permuted(slot + int(shard) * SLOTS, np.full(len(slot), edge[-1]), np.full(len(slot), seed))
                which = np.searchsorted(edge, ticket, "right") - 1
                turn, index = np.divmod(ticket - edge[which], blocks[which])
                take = permuted(index, blocks[which], _seeds(rank[which], turn, seed))
                yield pd.DataFrame({"rank": rank[which], "block": take, "shard": shard, "slot": slot, "last": ticket + 1 == edge[which + 1], "turn": turn, "words": np.minimum(block, size[which] - take * block)})

    return of


def slots_of(size: int, want: int, rank: int, block: int, seed: int) -> int:
    """Slots that give `want` words of a source of `size` words: whole turns over its blocks, then the blocks that the rest needs."""
    blocks, (whole, rest) = -(-size // block), divmod(want, size)
    k = -(-rest // block)
    if rest:  # one more if the short last block is among the rest and leaves too little
        one = np.ones(1, np.int64)
        place = int(permuted(one * (blocks - 1), one * blocks, one * _seeds(rank, whole, seed), back=True)[0])
        k += place < k and (k - 1) * block + size - (blocks - 1) * block < rest
    return whole * blocks + k


def slot_table(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """rank, block, shard, slot, last, words of every slot of the mix. The sources, one row each, come to the driver."""
    spark = sources.sparkSession
    s = sources.select("rank", "source_size", F.round("target").cast("long").alias("words")).where("source_size > 0").toPandas()
    s["blocks"] = -(-s["source_size"] // block)
    s["slots"] = [slots_of(int(n), int(w), int(r), block, seed) for r, n, w in zip(s["rank"], s["source_size"], s["words"])]
    shards = -(-int(s["slots"].sum()) // SLOTS)
    tasks = max(1, -(-shards // TASK_SHARDS), min(shards, spark.sparkContext.defaultParallelism))
    return spark.range(0, shards, 1, tasks).mapInPandas(_draws(s, seed, block), "rank long, block long, shard long, slot long, last boolean, turn long, words long")


SPANS = "array<struct<lead:int,doc_id:bigint,begin:bigint,start:int,n:int,text:string>>"


def _filled(block: int):
    """Slots of one part of a source, filled: rank, block, shard, slot, words, spans; whole if the part holds all words of the slot."""

    def of(docs: pa.Table, slots: pa.Table) -> pa.Table:
        docs = docs.take(pc.sort_indices(docs.select(["doc_id", "row_hash"]), sort_keys=[("doc_id", "ascending"), ("row_hash", "ascending")], null_placement="at_start"))
        begin, found, texts = np.zeros(docs.num_rows, np.int64), [], []
        upto = slots["offset"][0].as_py() if slots.num_rows else 0
        for i, j, data, at in common.slices(docs["text"]):
            first, last, row = common.word_bounds(data, at)
            size = np.bincount(row, minlength=j - i)
            begin[i:j] = upto + np.cumsum(size) - size
            upto += int(size.sum())
            if not len(first):
                continue
            start = np.arange(len(first)) - np.searchsorted(row, np.arange(j - i))[row]
            place = begin[i + row] + start
            cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (place[1:] // block != place[:-1] // block)))
            stop = np.append(cut[1:], len(first))
            # the words of a row with one space between them
            mark = np.zeros(len(data) + 1, np.int8)
            mark[first] += 1
            mark[last] -= 1
            word = np.cumsum(mark[:-1]) > 0
            gap = last[last < len(data)]
            gap = gap[~word[gap]]
            plain, keep = data.copy(), word
            plain[gap], keep[gap] = 32, True
            raw, to = plain[keep].tobytes(), np.cumsum(keep)
            texts += [raw[x:z] for x, z in zip((to[first[cut]] - 1).tolist(), to[last[stop - 1] - 1].tolist())]
            found.append(np.stack((place[cut] // block, place[cut] % block, i + row[cut], start[cut], stop - cut)))
        at_block, lead, row, start, n = np.concatenate(found, axis=1) if found else np.empty((5, 0), np.int64)
        order = np.lexsort((lead, at_block))
        wanted, words = common.int64(slots["block"]), common.int64(slots["words"])
        low, high = (np.searchsorted(at_block[order], wanted, side) for side in ("left", "right"))
        slot = np.repeat(np.arange(len(wanted)), high - low)
        piece = order[np.arange(len(slot)) - np.repeat(np.cumsum(high - low) - high, high - low)]
        size = np.minimum(n[piece], words[slot] - lead[piece])  # a trimmed slot ends inside or before a piece
        slot, piece, size = slot[size > 0], piece[size > 0], size[size > 0]
        text = [texts[k] if m == full else b" ".join(texts[k].split(b" ")[:m]) for k, m, full in zip(piece.tolist(), size.tolist(), n[piece].tolist())]
        ids = docs["doc_id"].combine_chunks().take(pa.array(row[piece]))
        spans = [pa.array(lead[piece], pa.int32()), ids, pa.array(begin[row[piece]]), pa.array(start[piece], pa.int32()), pa.array(size, pa.int32()), pa.array(text, pa.binary()).view(pa.string())]
        count = np.bincount(slot, minlength=len(wanted))
        some = np.flatnonzero(count)
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count[some]))), pa.int32()), pa.StructArray.from_arrays(spans, ["lead", "doc_id", "begin", "start", "n", "text"]))
        whole = np.bincount(slot, weights=size, minlength=len(wanted)).astype(np.int64) == words
        return pa.table([*(slots[c].take(pa.array(some)) for c in ("rank", "block", "shard", "slot", "words")), pa.array(whole[some]), spans], ["rank", "block", "shard", "slot", "words", "whole", "spans"])

    return of


def _mixed(docs: DataFrame, block: int, seed: int, weights: tuple[int, ...], share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """(placed, mix): doc_id, source, size, rank, source_size, target, begin of every row of docs, and rank,
    source, block, shard, slot, words, spans of every slot, of which all the words are written."""
    common.bounded_batches(docs.sparkSession)
    rows = common.written(sized(docs), "mix-sizes")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    steps = max(1, -(-total["n"] // STEP), -(-total["words"] // STEP_WORDS))
    sources = common.written(targets(rows, weights, share, cap), "mix-sources")
    named = sources.withColumnRenamed("source", "its_source")
    few = sources.count() <= BROADCAST_SOURCES  # a join by rank alone would send a large source's slots to one task
    by_source = F.broadcast if few else (lambda df: df)
    named = by_source(named)

    def keyed(rows: DataFrame, *columns: str) -> DataFrame:
        rows = rows.join(named, F.col("source").eqNullSafe(F.col("its_source")))
        part = F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(steps)).cast("long")
        return rows.select(F.col("rank").cast("long").alias("rank"), part.alias("part"), "doc_id", "row_hash", *columns)

    parts = common.written(parts_of(keyed(rows, "size")), "mix-parts")
    placed = common.written(place_in_source(keyed(rows, "source", "size", "source_size", "target"), parts).drop("row_hash", "part"), "mix-places")
    slots = common.written(slot_table(sources, block, seed), "mix-slots")
    # words that each block gives: all of it in each slot, but only as many as are missing in a source's last slot
    wanted = sources.select("rank", F.round("target").cast("long").alias("want"))
    short = slots.groupBy("rank").agg(F.sum("words").alias("sum")).join(wanted, "rank").select("rank", F.greatest(F.col("sum") - F.col("want"), F.lit(0)).alias("over"))
    slots = slots.join(by_source(short), "rank").withColumn("words", F.when(F.col("last"), F.greatest(F.col("words") - F.col("over"), F.lit(0))).otherwise(F.col("words")))
    holds = parts.where("n > 0").select("rank", "part", "offset", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("n") - 1) / block))).alias("block"))
    slots = slots.join(holds.hint("merge"), ["rank", "block"])  # a row for each block, though its size is estimated from parts
    # both sides of the cogroup need keys of one type, or equal keys are dealt to different tasks
    slots = slots.select(F.col("rank").cast("long").alias("rank"), F.col("part").cast("long").alias("part"), "offset", "block", "shard", "slot", "words")
    texts = keyed(plain(docs), "text")  # the running sums of `placed` are made again in each part, from its texts
    filled = texts.groupBy("rank", "part").cogroup(slots.groupBy("rank", "part")).applyInArrow(_filled(block), f"rank long, block long, shard long, slot long, words long, whole boolean, spans {SPANS}")
    filled = common.written(filled, "mix", "zstd")
    split = filled.where("not whole").groupBy("rank", "block", "shard", "slot", "words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    mix = filled.where("whole").drop("whole").unionByName(split)
    return placed, mix.join(named.select("rank", F.col("its_source").alias("source")), "rank")


def _in_order(mix: DataFrame) -> DataFrame:
    return mix.repartition("shard").sortWithinPartitions("shard", "slot")


def mixed_blocks(docs: DataFrame, block: int = BLOCK, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix: shard, slot, source, block (its number in the source), words, spans, text; whole shards in slot order.

    spans: doc_id, start (words of the document before it) and n (words) of each run of words of one
    document, in order; text has all these words, joined by one space. A slot has `block` words, less
    where its source ends and in a source's last slot, which is cut where the target is met.
    """
    mix = _in_order(_mixed(docs, block, seed, weights, share, cap)[1])
    spans = F.transform("spans", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["n"].alias("n")))
    return mix.select("shard", "slot", "source", "block", "words", spans.alias("spans"), F.array_join(F.transform("spans", lambda x: x["text"]), " ").alias("text"))


def mixed_spans(docs: DataFrame, block: int = BLOCK, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix by spans: shard, slot, lead (words of the slot before it), source, doc_id, start, taken (words), text; whole shards in order."""
    mix = _in_order(_mixed(docs, block, seed, weights, share, cap)[1]).select("shard", "slot", "source", F.explode("spans").alias("s"))
    return mix.select("shard", "slot", F.col("s.lead").alias("lead"), "source", F.col("s.doc_id").alias("doc_id"), F.col("s.start").alias("start"), F.col("s.n").cast("long").alias("taken"), F.col("s.text").alias("text"))


def mix_sources(docs: DataFrame, block: int = BLOCK, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    The mix is made and written (see mixed_blocks), and its spans are counted. A document's words are
    taken at most ceil(cap) times. Reruns with the same seed agree.

    Null, empty and wordless texts have size 0 and give nothing; a null source is a source. Rows without
    doc_id and repeated rows are documents of their own. Columns other than doc_id, source and text are
    not read. A table without words has targets of 0.
    """
    placed, mix = _mixed(docs, block, seed, weights, share, cap)
    spans = mix.select("rank", F.explode("spans").alias("s")).select(F.col("rank").alias("its_rank"), F.col("s.begin").alias("its_begin"), F.col("s.n").alias("n"))
    taken = spans.groupBy("its_rank", "its_begin").agg(F.sum("n").alias("taken"))
    same = (F.col("rank") == F.col("its_rank")) & (F.when(F.col("size") > 0, F.col("begin")) == F.col("its_begin"))
    return placed.join(taken, same, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def plain(docs: DataFrame) -> DataFrame:
    """doc_id, source, text (null: empty), row_hash (of the text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"), F.xxhash64(text).alias("row_hash"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), row_hash."""
    return plain(docs).select("doc_id", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), "row_hash")
