"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased (A-Z); items and windows are multisets of 5-word shingles, weighted by their
count. A window as long as an item gets a SimHash of BLOCKS * WIDTH bits of its weighted shingles. A
multi-index over the items' blocks gives all item fingerprints within RADIUS: if two fingerprints differ
in at most RADIUS bits, then some block differs in at most FLIPS bits, and every code within FLIPS bits
of each block of the window is looked up among the items' codes. The exact weighted similarity of the
shingles (sum of minima over sum of maxima) then verifies each candidate.

Every window that shares a shingle with an item of its length is fingerprinted: the others have an
exact similarity of 0. The items are an index of bounded size; more of them are taken in several parts,
each with a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U

SHINGLE, PERCENT = 5, 80
#: Blocks of a fingerprint, bits of a block, and bits of a block that may differ. A random item meets a window
#: in one block of these with a chance of 4 %.
BLOCKS, WIDTH, FLIPS = 20, 19, 3
#: Bits that fingerprints may differ in. Pairs of similarity 0.8 differ in about 58 of 380 bits, with a deviation of 7.
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Items (and their words) in one index at most.
ITEMS, ITEM_WORDS = 20_000, 2_000_000
#: Windows fingerprinted in one step, and fingerprints whose items a task remembers at most.
STEP, REMEMBERED = 2048, 50_000

_CODE = (1 << np.arange(WIDTH)).astype(np.int32)
_NEAR = np.array([sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(WIDTH), n)], np.int32)


def shingle_signs(value: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    words = -(-BLOCKS * WIDTH // 64)
    hashed = np.stack([common.mix(value + U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(words)], axis=1)
    bits = np.unpackbits(hashed.view(np.uint8), axis=1, count=BLOCKS * WIDTH)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def simhash(value: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Codes of the blocks of the windows of `size` shingles (repeated ones count as often) that start at `first`, ascending."""
    out = np.empty((len(first), BLOCKS), np.int32)
    for k in range(0, len(first), STEP):
        f = first[k : k + STEP]
        cut = np.flatnonzero(np.append(True, np.diff(f) > size))
        for a, z in zip(cut, np.append(cut[1:], len(f))):  # runs of windows that overlap
            lo = f[a]
            total = np.zeros((f[z - 1] + size - lo + 1, BLOCKS * WIDTH), np.int32)
            np.cumsum(shingle_signs(value[lo : f[z - 1] + size]), axis=0, out=total[1:])
            bits = total[f[a:z] - lo + size] > total[f[a:z] - lo]
            out[k + a : k + z] = bits.reshape(-1, BLOCKS, WIDTH) @ _CODE
    return out


@dataclass
class ItemIndex:
    """Items by number: id, shingle count, sorted distinct shingles with weights; shingle postings; codes of the fingerprints."""

    ids: np.ndarray
    size: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    post_key: np.ndarray
    post_size: np.ndarray
    codes: np.ndarray


class Blocks:
    """The multi-index, made from an index's codes in the task that reads it: which codes occur in a block (10 MB), and their items in order (160 bytes an item)."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.lead = (np.arange(BLOCKS, dtype=np.int32) << WIDTH)[:, None]
        keys = (codes.T + self.lead).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.item = keys[order], (order % max(len(codes), 1)).astype(np.int32)
        self.present = np.zeros(BLOCKS << WIDTH, bool)
        self.present[keys] = True
        self.known: dict[bytes, np.ndarray] = {}

    def looked_at(self, code: np.ndarray) -> np.ndarray:
        """Items that have a code within FLIPS bits in the same block."""
        probe = ((code[:, None] ^ _NEAR) + self.lead).ravel()
        probe = probe[self.present[probe]]
        lo, hi = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
        return np.unique(self.item[at])

    def near(self, code: np.ndarray) -> np.ndarray:
        """All items whose fingerprint differs in at most RADIUS bits."""
        key = code.tobytes()
        if key not in self.known:
            found = self.looked_at(code)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1) <= RADIUS]
        return self.known[key]


def build_index(rows: list[tuple[int, str]]) -> ItemIndex:
    rows = [(i, t) for i, t in rows if t and t.strip(" \t\n\v\f\r")]
    ids, values, weights, sizes, codes = [], [], [], [], [np.empty((0, BLOCKS), np.int32)]
    for i, t in rows:
        g = _shingles(np.frombuffer(t.encode(), np.uint8))
        v, n = np.unique(g, return_counts=True)
        ids.append(i)
        values.append(v)
        weights.append(n)
        sizes.append(len(g))
        codes.append(simhash(g, np.zeros(1, np.int64), len(g)))
    value = np.concatenate([np.empty(0, U), *values])
    at = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int64)
    weight, size = np.concatenate([np.empty(0, np.int64), *weights]), np.array(sizes, np.int64)
    post = np.unique(np.stack([value, np.repeat(size, np.diff(at)).astype(U)]), axis=1) if len(value) else np.empty((2, 0), U)
    return ItemIndex(np.array(ids, np.int64), size, value, weight, at, post[0], post[1].astype(np.int64), np.concatenate(codes))


def _shingles(data: np.ndarray) -> np.ndarray:
    """Shingles of one text in order; the whole sequence as one if it is shorter."""
    start, end, _ = common.word_bounds(data, np.array([0, len(data)]))
    h = common.word_hashes(data, start, end, lower=True)
    if len(h) >= SHINGLE:
        return common.kgrams(h, SHINGLE)
    return common.kgrams(h, len(h)) if len(h) else np.empty(0, U)


def _matches(g: np.ndarray, index: ItemIndex, blocks: Blocks, hits: np.ndarray, percent: int) -> dict[int, tuple[int, int]]:
    """item number -> (minima, maxima) of the most similar window, of one document's shingles; hits: places of items' shingles."""
    lo, hi = np.searchsorted(index.post_key, g[hits], "left"), np.searchsorted(index.post_key, g[hits], "right")
    place = np.repeat(hits, hi - lo)
    size_of = index.post_size[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(place))]
    best: dict[int, tuple[int, int]] = {}
    for size in np.unique(size_of).tolist():
        p, width = place[size_of == size], min(size, len(g))
        if len(g) < size:  # a document a little shorter than the item is one window
            first = np.zeros(1 if 100 * len(g) >= percent * size else 0, np.int64)
        else:  # the windows that hold one of the places
            cover = np.zeros(len(g) + 1, np.int64)
            np.add.at(cover, np.maximum(p - size + 1, 0), 1)
            np.add.at(cover, p + 1, -1)
            first = np.flatnonzero(np.cumsum(cover[: len(g) - size + 1]) > 0)
        for a, code in zip(first.tolist(), simhash(g, first, width)):
            near = blocks.near(code)
            if not len(near):
                continue
            v, n = np.unique(g[a : a + width], return_counts=True)
            for k in near.tolist():
                x, w = index.value[index.at[k] : index.at[k + 1]], index.weight[index.at[k] : index.at[k + 1]]
                where = np.minimum(np.searchsorted(v, x), len(v) - 1)
                both = int(np.minimum(n[where], w)[v[where] == x].sum())
                union = width + int(index.size[k]) - both
                if 100 * both >= percent * union and (k not in best or both * best[k][1] > best[k][0] * union):
                    best[k] = both, union
    return best


def _scan(index: ItemIndex, percent: int):
    known = np.unique(index.post_key)
    table = np.zeros(1 << 20, bool)
    table[(known >> U(44)).astype(np.int64)] = True

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(index.codes)
        for b in batches:
            ids = common.int64(b.column(0))
            for i, j, data, at in common.slices(b.column(1)):
                start, end, row = common.word_bounds(data, at)
                h = common.word_hashes(data, start, end, lower=True)
                words = np.bincount(row, minlength=j - i)
                begin = np.concatenate(([0], np.cumsum(words)))
                found: dict[str, list] = {"row_key": [], "item_id": [], "similarity": []}
                whole = common.kgrams(h, SHINGLE)
                maybe = np.flatnonzero(table[(whole >> U(44)).astype(np.int64)])
                sure = maybe[known[np.minimum(np.searchsorted(known, whole[maybe]), len(known) - 1)] == whole[maybe]] if len(known) else maybe
                sure = sure[row[sure] == row[sure + SHINGLE - 1]]
                docs = np.unique(np.concatenate((row[sure], np.flatnonzero((words > 0) & (words < SHINGLE)))))
                for d in docs.tolist():
                    mine = h[begin[d] : begin[d + 1]]
                    g = common.kgrams(mine, min(SHINGLE, len(mine)))
                    hits = np.flatnonzero(np.isin(g, known))
                    if not len(hits):
                        continue
                    for k, (both, union) in sorted(_matches(g, index, blocks, hits, percent).items()):
                        found["row_key"].append(ids[i + d])
                        found["item_id"].append(int(index.ids[k]))
                        found["similarity"].append(both / union)
                if found["row_key"]:
                    yield pa.RecordBatch.from_pydict(found, schema=pa.schema([("row_key", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64())]))

    return of


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, similarity) of the most similar window of each item with at least percent; see `decontaminate`."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    chunks = max(1, -(-size["n"] // ITEMS), -(-size["chars"] // (ITEM_WORDS * 4)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    out = None
    for c in range(chunks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).orderBy("item_id", "text").collect()
        index = build_index([(r["item_id"], r["text"]) for r in part])
        found = rows.mapInArrow(_scan(index, percent), "doc_id long, item_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending), best_similarity: one row for each doc_id.

    A document is contaminated if one of its windows, as long as a benchmark item, has a weighted
    5-word-shingle similarity of at least percent / 100 to it. An item of fewer than 5 words is one
    shingle and matches only documents of exactly these words.

    Null, empty and wordless texts and items match nothing. Rows without doc_id are not compared:
    contaminated false. Rows that repeat a doc_id are one document, contaminated if any of them is; rows
    that repeat an item_id are variants of it. Columns other than doc_id, item_id and text are not read.
    """
    matches = benchmark_matches(docs, benchmark, percent).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("best_similarity"))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    loose = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is null")
    return each.unionByName(loose).join(matches, "doc_id", "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity"),
    )
