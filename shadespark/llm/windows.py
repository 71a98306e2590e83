"""Exact search for windows (runs of a fixed number of words or bytes) that also start earlier in the corpus.

The plan, shared by the suffix-array and the super-k-mer operator:

1. Every window has a minimiser, the smallest hash among the k-grams in it. Equal windows have equal
   minimisers, so a minimiser that occurs once in the corpus rules out all its windows. One row goes out
   for each distinct minimiser of a document (a few per cent of the text).
2. Rows that repeat a doc_id are cut down to one, the row of the smallest content hash. Documents of equal
   content are one document; the first stands for all.
3. Consecutive windows that share a minimiser travel as one packed string, to the bucket of the
   minimiser, and only those whose minimiser is repeated. A minimiser with more than HOT strings is
   split by document over several buckets.
4. A bucket compares its windows exactly (the operator's own method) and reports the later copies.
   Windows of split minimisers that are first in their bucket go on, one row for each distinct window
   and bucket, and a window function keeps the first.
5. The reported windows of a document are joined with its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .common import U

#: Strings of one minimiser that share a bucket at most.
HOT = 4096
#: Packed strings that a bucket holds at most, if every minimiser were repeated.
PER_BUCKET = 20_000
#: High bits of a k-gram's hash that rank it; the other 24 hold its place among the SPAN windows of one step.
RANK_BITS, SPAN = 40, 1 << 23


@dataclass(frozen=True)
class Unit:
    """What windows are made of: its tokens, window length and k-gram length, and how a bucket compares windows."""

    name: str
    window: int
    kgram: int
    words: bool
    #: Strings of a bucket in document order -> for each string, the relative starts of windows that start earlier in the bucket.
    compare: Callable[[list[bytes], int], list[np.ndarray]]

    def tokens(self, data: np.ndarray, at: np.ndarray):
        """Hash, document, first byte and last byte + 1 of each token."""
        if self.words:
            start, end, doc = common.word_bounds(data, at)
            return common.word_hashes(data, start, end, lower=False), doc, start, end
        place = np.arange(len(data))
        return common.byte_hashes(data), np.repeat(np.arange(len(at) - 1), np.diff(at)), place, place + 1


def runs(h: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window + 1 and minimiser of the runs of windows of one document that share a minimiser.

    A window's minimiser is its k-gram of the smallest RANK_BITS high bits, the leftmost of equal ones: that
    hangs on the window alone, not on the slice it is read in. Long slices go by SPAN windows.
    """
    if len(h) < window:
        return (np.empty(0, np.int64),) * 3
    parts = [_runs(h[a : a + SPAN + window - 1], doc[a : a + SPAN + window - 1], a, window, k) for a in range(0, len(h) - window + 1, SPAN)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs(h: np.ndarray, doc: np.ndarray, lead: int, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g, low = common.kgrams(h, k), U(64 - RANK_BITS)
    place = common.sliding_min((g >> low << low) | np.arange(len(g), dtype=U), window - k + 1) & ((U(1) << low) - U(1))
    first = np.flatnonzero(doc[: len(place)] == doc[window - 1 :])
    place = place[first].astype(np.int64)
    new = np.ones(len(first), bool)
    new[1:] = place[1:] != place[:-1]
    last = np.append(new[1:], True)[: len(first)]
    return first[new] + lead, first[last] + 1 + lead, g[place[new]].view(np.int64)


def contents(docs: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, n (tokens), sha (of the content that windows see): one row for each row of docs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha = [], []
            for x in b.column(1):
                w = (x.as_py() or "").encode().split()
                n.append(len(w))
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n", "sha"])

    if unit.words:
        return docs.mapInArrow(of, "doc_id long, n long, sha string")
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n"), F.sha2(text, 256).alias("sha"))


def _minimisers(unit: Unit):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = common.int64(b.column(0))
            for i, _, data, at in common.slices(b.column(1)):
                h, doc, _, _ = unit.tokens(data, at)
                first, _, key = runs(h, doc, unit.window, unit.kgram)
                if not len(key):
                    continue
                of_doc = doc[first]
                order = np.lexsort((key, of_doc))
                key, of_doc = key[order], of_doc[order]
                begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of_doc[1:] != of_doc[:-1])))
                times = np.diff(np.append(begin, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(key[begin]), pa.array(ids[i + of_doc[begin]]), pa.array((times > 1))], ["key", "doc_id", "again"])

    return of


def _strings(unit: Unit, buckets: int):
    """Packed strings of the runs whose minimiser is in the document's list; runs that repeat an earlier one of their document are merged and reported at once, without a string."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = common.int64(b.column(0))
            lists = b.column(2)
            at_list = lists.offsets.to_numpy().astype(np.int64)
            values, parts = common.int64(lists.flatten()), common.int64(b.column(3).flatten())
            at_list = at_list - at_list[0]
            for i, j, data, at in common.slices(b.column(1)):
                h, doc, begin, end = unit.tokens(data, at)
                first, last, key = runs(h, doc, unit.window, unit.kgram)
                if not len(key):
                    continue
                lo, hi = at_list[i], at_list[j]
                salt = common.mix(np.arange(1, j - i + 1, dtype=U) << U(20))
                wanted = values[lo:hi].view(U) ^ np.repeat(salt, np.diff(at_list[i : j + 1]))
                order = np.argsort(wanted)
                wanted = wanted[order]
                have = key.view(U) ^ salt[doc[first]]
                where = np.minimum(np.searchsorted(wanted, have), max(len(wanted) - 1, 0))
                hit = np.flatnonzero(wanted[where] == have) if len(wanted) else np.empty(0, np.int64)
                many = parts[lo:hi][order][where[hit]]
                raw, seen = data.tobytes(), {}
                doc_first = np.searchsorted(doc, np.arange(j - i))
                out: dict[str, list] = {"bucket": [], "doc_id": [], "start": [], "stop": [], "hot": [], "packed": []}
                inside: dict[int, list] = {}
                for r, n_parts in zip(hit.tolist(), many.tolist()):
                    a, z, d = int(first[r]), int(last[r]), int(doc[first[r]])
                    lead = int(doc_first[d])
                    stop = z + unit.window - 1
                    if unit.words:
                        packed = b" ".join(raw[x:y] for x, y in zip(begin[a:stop].tolist(), end[a:stop].tolist()))
                    else:
                        packed = raw[a:stop]
                    if (d, packed) in seen:
                        inside.setdefault(d, []).append((a - lead, stop - lead))
                        continue
                    seen[d, packed] = True
                    k, doc_id = int(key[r]), int(ids[i + d])
                    part = 0 if n_parts < 2 else int(common.mix(np.array([doc_id & (2**64 - 1)], U))[0] % U(n_parts))
                    out["bucket"].append(hash((k, part)) % buckets)
                    out["doc_id"].append(doc_id)
                    out["start"].append(a - lead)
                    out["stop"].append(stop - lead)
                    out["hot"].append(n_parts > 1)
                    out["packed"].append(packed)
                for d, found in inside.items():
                    for start, stop in merged(found):
                        for name, x in (("bucket", hash(int(ids[i + d])) % buckets), ("doc_id", int(ids[i + d])), ("start", start), ("stop", stop), ("hot", False), ("packed", None)):
                            out[name].append(x)
                if out["bucket"]:
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("hot", pa.bool_()), ("packed", pa.binary())]))

    return of


def _bucket(unit: Unit):
    """Of one bucket: (doc_id, start, stop) of reported runs of tokens, or with `window` a first window of a split minimiser."""

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        ids, starts, stops = (common.int64(table[c]) for c in ("doc_id", "start", "stop"))
        hot, packed = table["hot"].to_pylist(), table["packed"].to_pylist()
        doc_id, start, stop, window = [], [], [], []

        def tell(i: int, a: int, z: int, what: bytes | None = None) -> None:
            doc_id.append(ids[i])
            start.append(a)
            stop.append(z)
            window.append(what)

        first: dict[bytes, bool] = {}
        kept = []
        for i, p in enumerate(packed):
            if p is None or p in first:  # every window of it starts earlier
                tell(i, starts[i], stops[i])
            else:
                first[p] = True
                kept.append(i)
        for i, later in zip(kept, unit.compare([packed[i] for i in kept], unit.window)):
            if len(later):  # runs of consecutive windows
                cut = np.flatnonzero(np.diff(later) > 1)
                for a, z in zip(later[np.append(0, cut + 1)], later[np.append(cut, len(later) - 1)]):
                    tell(i, starts[i] + a, starts[i] + z + unit.window)
            if hot[i]:
                n, gone = stops[i] - starts[i] - unit.window + 1, set(later.tolist())
                words = packed[i].split(b" ") if unit.words else None
                for a in range(n):
                    if a not in gone:
                        whole = b" ".join(words[a : a + unit.window]) if unit.words else packed[i][a : a + unit.window]
                        tell(i, starts[i] + a, starts[i] + a + unit.window, hashlib.sha256(whole).digest())
        return pa.table([pa.array(np.array(doc_id, np.int64)), pa.array(np.array(start, np.int32)), pa.array(np.array(stop, np.int32)), pa.array(window, pa.binary())], ["doc_id", "start", "stop", "window"])

    return of


def _once(docs: DataFrame, unit: Unit, each: DataFrame) -> DataFrame:
    """docs with one row for each doc_id: the one whose content has the sha in each. Only rows that repeat a doc_id are grouped."""
    again = each.where("times > 1").select(F.col("doc_id").alias("its_id"), F.col("sha").alias("of_sha"))
    if again.isEmpty():
        return docs
    same = F.col("doc_id") == F.col("its_id")
    rows = docs.join(again, same, "left_semi")
    if unit.words:
        sha = F.udf(lambda x: hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest(), "string")(F.col("text"))
    else:
        sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = rows.withColumn("sha", sha).join(again, same & (F.col("sha") == F.col("of_sha"))).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return common.written(docs.join(again, same, "left_anti").unionByName(rows), f"{unit.name}-once")


def repeated(docs: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, contents, spans). docs: doc_id, text, one row for each doc_id; contents: doc_id, n, sha, first (the
    smallest doc_id of equal content), likewise; spans: doc_id, spans array<struct<start, stop>> of documents that
    stand for themselves, in tokens, which may overlap. A doc_id that repeats with other texts counts with its smallest sha."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    each = contents(docs, unit).groupBy("doc_id").agg(F.min(F.struct("sha", "n")).alias("c"), F.count("*").alias("times"))
    each = common.written(each.select("doc_id", "c.n", "c.sha", "times"), f"{unit.name}-contents")
    docs, each = _once(docs, unit, each), each.drop("times")
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    firsts = each.groupBy("sha").agg(F.min("doc_id").alias("first"))
    known = each.join(firsts, "sha")
    buckets = int(max(8, -(-total * 2 // (unit.window - unit.kgram + 2) // PER_BUCKET)))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # Stored, so that the corpus is read once. Counts are partial sums before they are shuffled, and the join below is one that
    # Spark may split: a passage that most documents share puts no more than the rows of one of its splits into a task.
    one = common.written(docs.mapInArrow(_minimisers(unit), "key long, doc_id long, again boolean").where("key is not null and doc_id is not null"), f"{unit.name}-minimisers", "zstd")
    often = one.groupBy("key").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high or again")
    often = common.written(often.select("key", F.ceil(F.col("n") / HOT).cast("long").alias("parts")), f"{unit.name}-often")
    stand = firsts.select(F.col("first").alias("doc_id"))
    wanted = one.join(often, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "parts", "again")).alias("found")).join(stand, "doc_id")
    wanted = wanted.select("doc_id", F.col("found.key").alias("keys"), F.col("found.parts").alias("parts"), F.exists("found", lambda x: x["again"]).alias("again"))
    strings = docs.repartition(shuffles, "doc_id").join(wanted, "doc_id").select("doc_id", "text", "keys", "parts", "again").mapInArrow(_strings(unit, buckets), "bucket int, doc_id long, start int, stop int, hot boolean, packed binary")
    found = common.written(strings.groupBy("bucket").applyInArrow(_bucket(unit), "doc_id long, start int, stop int, window binary"), f"{unit.name}-found")
    order = Window.partitionBy("window").orderBy("doc_id", "start")
    later = found.where("window is not null").withColumn("rank", F.row_number().over(order)).where("rank > 1")
    spans = found.where("window is null").select("doc_id", "start", "stop").unionByName(later.select("doc_id", "start", "stop"))
    return docs, known, spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of the tokens that spans cover."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def maybe_repeated(h: np.ndarray, k: int, begin: np.ndarray) -> np.ndarray:
    """The starts in begin whose k-gram may occur at another of them; drops none that does."""
    g = common.kgrams(h, k)
    for shift in (0, 24, 40):
        if len(begin):
            slot = ((g[begin] >> U(shift)) & U(0x3FFFFF)).astype(np.int64)
            begin = begin[np.bincount(slot, minlength=1 << 22)[slot] > 1]
    return begin


def doubled_ranks(key: np.ndarray, unit: int, window: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of windows by prefix doubling, in the order of their tokens.

    key: order-keeping numbers of the strings of `unit` tokens at each place; begin: places where
    windows start. Returns those starts whose window occurs at another of them, and its rank.
    A start drops out as soon as a part of its window occurs once.
    """
    n, size, live = len(key), unit, begin
    rank = np.zeros(n, U)
    while True:
        here = np.zeros(n, bool)
        for shift in _shifts(size, window):
            here[live + shift] = True
        here = np.flatnonzero(here)
        _, inverse, count = np.unique(key[here], return_inverse=True, return_counts=True)
        rank[here] = inverse.astype(U) + U(1)
        often = np.zeros(n, bool)
        often[here] = count[inverse] > 1
        if size == window:  # counted among the starts alone
            _, inverse, count = np.unique(rank[live], return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            return live[again], rank[live[again]]
        keep = np.ones(len(live), bool)
        for shift in _shifts(size, window):
            keep &= often[live + shift]
        live = live[keep]
        step = size if size * 2 <= window else window - size
        key = (rank << U(32)) | np.append(rank[step:], np.zeros(step, U))
        size += step


def _shifts(size: int, window: int) -> list[int]:
    """Offsets in a window of the strings of this size that this and later steps read."""
    out = {0}
    while size < window:
        step = size if size * 2 <= window else window - size
        out |= {x + step for x in out}
        size += step
    return sorted(out)


def by_string(places: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Places in joined strings of these lengths -> ascending relative places in each."""
    begin = np.concatenate(([0], np.cumsum(lengths)))
    places = np.sort(places)
    cut = np.searchsorted(places, begin)
    return [places[a:z] - b for a, z, b in zip(cut[:-1], cut[1:], begin[:-1])]


def window_starts(lengths: np.ndarray, window: int) -> np.ndarray:
    """Places in joined strings of these lengths where a whole window starts."""
    begin = np.cumsum(lengths) - lengths
    n = np.maximum(lengths - window + 1, 0)
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
