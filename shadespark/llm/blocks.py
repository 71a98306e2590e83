"""Links inside groups of any size: groups are compared in blocks, and components that are known are not compared again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components


def _dests(rows: DataFrame, pair: Column, own: Column, buckets: int) -> DataFrame:
    """doc_id, bucket, pair, side, comp: where each row goes. A block of a large group has a bucket of its own; small groups share them."""
    bucket = F.when(own, -1 - F.pmod(F.col("pair"), F.lit(1 << 40))).otherwise(F.pmod(F.xxhash64("pair"), F.lit(buckets)))
    return rows.withColumn("pair", pair).select("doc_id", bucket.alias("bucket"), "pair", F.col("side").cast("int").alias("side"), "comp")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with comp: the component of their doc_id under the links."""
    known = connected_components(links).select(F.col("node").alias("doc_id"), "component")
    return written(rows.join(known, "doc_id", "left").select("grp", "doc_id", "w", F.coalesce("component", "doc_id").alias("comp")), "labelled")


def group_links(members: DataFrame, compare: Callable[[DataFrame], DataFrame], block: int, buckets: int) -> DataFrame:
    """Links (a, b) that join, within each group, all pairs that compare would link.

    members (a written table): grp, doc_id, w (weight). compare takes the places of documents (see _dests) and
    gives links of rows with the same pair and different comp, and of different sides where a pair has two.

    A group over `block` in weight is cut into blocks. Each block is compared within itself; then one
    document stands for each component, and these are compared, as long as that halves their number; at
    last all documents outside the group's heaviest component meet all others of other components. One
    component of near copies, however large, thus costs a pass, and only the rest of its group is
    compared with it in full.
    """
    weights = members.groupBy("grp").agg(F.sum("w").alias("all"))
    blocks = F.greatest(F.ceil(F.col("all") / block), F.lit(1))
    many = written(weights.where(F.col("all") > block).withColumn("blocks", blocks), "large-groups")
    large = not many.isEmpty()

    def cut(rows: DataFrame) -> DataFrame:
        """Each row in one block of its group, by a hash, so that a document meets others in its other groups."""
        sized = rows.join(rows.groupBy("grp").agg(F.sum("w").alias("all")), "grp")
        pair = F.when(F.col("all") <= block, F.col("grp")).otherwise(F.xxhash64("grp", F.pmod(F.xxhash64("doc_id", "grp"), F.ceil(F.col("all") / block))))
        return _dests(sized.withColumns({"side": F.lit(0), "comp": F.col("doc_id")}), pair, F.col("all") > block, buckets)

    if not large:
        return compare(_dests(members.withColumns({"side": F.lit(0), "comp": F.col("doc_id")}), F.col("grp"), F.lit(False), buckets))
    links = written(compare(cut(members)).distinct(), "block-links")
    rest = written(members.join(many.select("grp"), "grp", "left_semi"), "large-members")
    labelled, before = _labelled(rest, links), None
    while True:
        heads = written(labelled.groupBy("grp", "comp").agg(F.min(F.struct("doc_id", "w")).alias("head")).select("grp", "head.doc_id", "head.w"), "heads")
        n = heads.count()
        if before is not None and 2 * n > before:
            break
        before = n
        links = written(links.unionByName(compare(cut(heads))).distinct(), "block-links")
        labelled = _labelled(rest, links)
    heavy = labelled.groupBy("grp", "comp").agg(F.sum("w").alias("s")).groupBy("grp").agg(F.max(F.struct("s", "comp")).alias("h"), F.sum("s").alias("all"))
    sizes = heavy.select("grp", F.col("h.comp").alias("heavy"), F.ceil(F.col("h.s") / block).alias("p"), F.ceil((F.col("all") - F.col("h.s")) / block).alias("q")).where("q > 0")
    rows = labelled.join(sizes, "grp").withColumn("of_heavy", F.col("comp") == F.col("heavy"))
    spread = F.xxhash64("doc_id", F.lit("side"))
    rows = rows.withColumn("side", F.when(F.col("of_heavy"), F.col("q") + F.pmod(spread, F.col("p"))).otherwise(F.pmod(spread, F.col("q"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("of_heavy"), F.col("q") - 1).otherwise(F.col("p") + F.col("q") - 1))))
    last = _dests(rows, F.xxhash64("grp", F.least("side", "other"), F.greatest("side", "other")), F.lit(True), buckets)
    return links.unionByName(compare(last))
