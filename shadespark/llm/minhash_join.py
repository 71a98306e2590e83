"""MinHash near-dedup by an inverted join on signature coordinates.

Documents with the same shingle set are one class. Each class posts itself under its coordinate-value
pairs. Pairs of a similarity at the threshold agree in most coordinates, so a pair is kept if at least
MATCH of COORDS collide: a document with fewer than MATCH shared postings leaves (skip), and one with
more posts only its rarest, all but MATCH - 1 of them (prefix), since a kept pair shares one of those.
Within a posting list, collisions are counted by comparing whole signatures, and pairs already joined are skipped.

The pairs only gather candidates into families. Each document's full shingle set then travels once, to
its family, where links are confirmed exactly; components of confirmed links are found by a distributed
star algorithm. Long lists and large families are compared in blocks (see `blocks`): near copies that are
one component already are not compared with each other again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U
from .blocks import group_links
from .components import connected_components

#: Coordinates of a signature, and how many must collide. A pair of similarity 0.8 misses with a chance of about 5e-7.
COORDS, MATCH = 48, 24
#: Documents of a posting list in one block; shingles of a family in one block.
LIST_BLOCK, FAMILY_BLOCK = 4096, 1_000_000

_rng = np.random.default_rng(48)
_MULTIPLY, _FLIP = _rng.integers(1, 2**63, COORDS, dtype=U) | U(1), _rng.integers(1, 2**63, COORDS, dtype=U)


def _signatures(shingle: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in common.slices(b.column(1)):
                value, begin = common.shingle_sets(data, at, shingle)
                size = np.diff(begin)
                some = np.flatnonzero(size)
                sig = np.zeros((j - i, COORDS), np.uint32)
                if len(some):
                    for c in range(COORDS):
                        sig[some, c] = np.minimum.reduceat(((value ^ _FLIP[c]) * _MULTIPLY[c]) >> U(32), begin[some])
                raw = value.tobytes()
                digest = [hashlib.blake2b(raw[8 * a : 8 * z], digest_size=16).digest() for a, z in zip(begin[:-1].tolist(), begin[1:].tolist())]
                packed = common.binary_rows(sig, np.arange(j - i + 1) * COORDS)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), packed], ["doc_id", "n", "digest", "sig"])

    return of


def _matrix(column) -> np.ndarray:
    data, at = common.text_buffer(column)
    return np.ascontiguousarray(data[at[0] : at[-1]]).view(np.uint32).reshape(-1, COORDS)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = _matrix(b.column(1)).astype(U) | (np.arange(1, COORDS + 1, dtype=U) << U(32))
        yield pa.RecordBatch.from_arrays([pa.array(common.mix(sig.ravel()).view(np.int64)), pa.array(np.repeat(common.int64(b.column(0)), COORDS))], ["key", "doc_id"])


def _collisions(table: pa.Table) -> pa.Table:
    """Of posting lists (pair, doc_id, side, comp, sig): edges that join all pairs with MATCH collisions."""
    table = table.sort_by([("pair", "ascending"), ("doc_id", "ascending")])
    lists, ids, side, known, sig = common.int64(table["pair"]), common.int64(table["doc_id"]), common.int64(table["side"]), common.int64(table["comp"]), _matrix(table["sig"])
    begin = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
    size = np.diff(np.append(begin, len(lists)))
    two = begin[size == 2]
    two = two[((sig[two] == sig[two + 1]).sum(axis=1) >= MATCH) & (known[two] != known[two + 1])]
    a, b = [ids[two]], [ids[two + 1]]
    for lo, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
        s, part, comp = sig[lo : lo + n], side[lo : lo + n], np.unique(known[lo : lo + n], return_inverse=True)[1]
        cross = part.min() != part.max()  # two blocks: each is compared within itself elsewhere
        for i in range(n - 1):
            rest = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            if cross:
                rest = rest[part[rest] != part[i]]
            if len(rest):
                hit = rest[(s[rest] == s[i]).sum(axis=1) >= MATCH]
                if len(hit):
                    comp[np.isin(comp, comp[hit])] = comp[i]
                    a.append(np.full(len(hit), ids[lo + i]))
                    b.append(ids[lo + hit])
    return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _sets(shingle: int):
    """Each member's shingle set, once for each of its places."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("bucket", "pair", "side", "comp")
        for b in batches:
            ids, places = common.int64(b.column(0)), b.column(2).to_pylist()
            digests = b.column(3).to_pylist()
            for i, j, data, at in common.slices(b.column(1)):
                value, begin = common.shingle_sets(data, at, shingle)
                raw = value.tobytes()
                out: dict[str, list] = {n: [] for n in (*names, "doc_id", "shingles")}
                for d in range(j - i):
                    mine = raw[8 * begin[d] : 8 * begin[d + 1]]
                    if hashlib.blake2b(mine, digest_size=16).digest() != digests[i + d]:
                        continue  # another text of a repeated doc_id
                    for place in places[i + d]:
                        for n in names:
                            out[n].append(place[n])
                        out["doc_id"].append(int(ids[i + d]))
                        out["shingles"].append(mine)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("pair", pa.int64()), ("side", pa.int32()), ("comp", pa.int64()), ("doc_id", pa.int64()), ("shingles", pa.binary())]))

    return of


def _links(percent: int):
    def of(table: pa.Table) -> pa.Table:
        """Of families or blocks (pair, doc_id, side, comp, shingles): links that join all pairs at the threshold."""
        table = table.sort_by([("pair", "ascending"), ("doc_id", "ascending")])
        family, ids, side, known = (common.int64(table[c]) for c in ("pair", "doc_id", "side", "comp"))
        data, at = common.text_buffer(table["shingles"])
        value, at = np.ascontiguousarray(data[at[0] : at[-1]]).view(U), (at - at[0]) // 8
        begin = np.flatnonzero(np.append(True, family[1:] != family[:-1]))
        a, b = [], []
        for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(family)).tolist()):
            n, off = hi - lo, at[lo : hi + 1] - at[lo]
            _, flat = np.unique(value[at[lo] : at[hi]], return_inverse=True)
            size, part, comp = np.diff(off), side[lo:hi], np.unique(known[lo:hi], return_inverse=True)[1]
            mark = np.zeros(len(flat) + 1, np.int32)
            cross = part.min() != part.max()
            for i in range(n - 1):
                fit = (comp[i + 1 :] != comp[i]) & (100 * np.minimum(size[i + 1 :], size[i]) >= percent * np.maximum(size[i + 1 :], size[i]))
                if cross:
                    fit &= part[i + 1 :] != part[i]
                rest = np.flatnonzero(fit) + i + 1
                if not len(rest):
                    continue
                own = flat[off[i] : off[i + 1]]
                mark[own] = 1
                if len(rest) * 4 > n - i:
                    both = np.add.reduceat(mark[flat[off[i + 1] :]], off[i + 1 : -1] - off[i + 1])[rest - i - 1]
                else:
                    both = np.array([mark[flat[off[j] : off[j + 1]]].sum() for j in rest])
                mark[own] = 0
                hit = rest[100 * both >= percent * (size[i] + size[rest] - both)]
                if len(hit):
                    comp[np.isin(comp, comp[hit])] = comp[i]
                    a.append(np.full(len(hit), ids[lo + i]))
                    b.append(ids[lo + hit])
        none = np.empty(0, np.int64)
        return pa.table([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    return of


def minhash_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate components of documents: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z); a document's set is its distinct `shingle`-word shingles, or its whole
    word sequence if shorter. Documents link if 100 * intersection >= percent * union; component_id is the
    smallest doc_id reachable, itself included, and kept marks it. Signatures are laid out for percent >= 80.

    Null, empty and wordless texts have no shingles and link with nothing. Rows without doc_id link with
    nothing: component_id null, kept true. Rows that repeat a doc_id are one document; if their sets
    differ, the one with the smallest digest. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    of = _signatures(shingle)
    form = "doc_id long, n long, digest binary, sig binary"
    known = docs.where("doc_id is not null")
    sigs = common.written(known.mapInArrow(of, form).groupBy("doc_id").agg(F.min(F.struct("digest", "n", "sig")).alias("s")).select("doc_id", "s.*"), "signatures")
    classes = sigs.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"))
    firsts = common.written(sigs.join(classes.select(F.col("first").alias("doc_id")), "doc_id").where("n > 0"), "classes")
    total = firsts.count()

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # stored, counted by partial sums, and joined in a way that Spark may split: many documents may have a coordinate's value in common
    posts = common.written(firsts.select("doc_id", "sig").mapInArrow(_postings, "key long, doc_id long"), "postings")
    shared = common.written(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    lists = posts.join(shared, "key").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("posts")).where(F.size("posts") >= MATCH)
    prefix = lists.select("doc_id", F.explode(F.slice("posts", F.lit(1), F.size("posts") - (MATCH - 1))).alias("p")).select(F.col("p.key").alias("grp"), "doc_id", F.lit(1).cast("long").alias("w"))
    prefix = common.written(prefix, "prefix")

    def compare_lists(places: DataFrame) -> DataFrame:
        return places.join(firsts.select("doc_id", "sig"), "doc_id").groupBy("bucket").applyInArrow(_collisions, "a long, b long")

    families = connected_components(group_links(prefix, compare_lists, LIST_BLOCK, max(8, total // 5000)))
    members = common.written(families.join(firsts.select(F.col("doc_id").alias("node"), "n", "digest"), "node").select(F.col("component").alias("grp"), F.col("node").alias("doc_id"), F.col("n").alias("w"), "digest"), "families")

    def compare_families(places: DataFrame) -> DataFrame:
        wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "pair", "side", "comp")).alias("places")).join(members.select("doc_id", "digest"), "doc_id")
        text = known.repartition(shuffles, "doc_id").join(wanted, "doc_id").select("doc_id", "text", "places", "digest")
        sets = text.mapInArrow(_sets(shingle), "bucket long, pair long, side int, comp long, doc_id long, shingles binary")
        return sets.groupBy("bucket").applyInArrow(_links(percent), "a long, b long")

    buckets = max(8, int((members.agg(F.sum("w").alias("n")).first()["n"] or 0) // 500_000))
    joined = connected_components(group_links(members.drop("digest"), compare_families, FAMILY_BLOCK, buckets))

    place = classes.join(joined, F.col("first") == F.col("node"), "left").select("digest", F.coalesce("component", "first").alias("component_id"))
    out = sigs.join(place, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")).alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    loose = docs.where("doc_id is null").mapInArrow(of, form)
    return out.unionByName(loose.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))
