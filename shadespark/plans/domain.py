"""Domain anchors: for each colour word, a typical shade of the catalogue near the word's hue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color
from ..operators import aggregates, relational
from ..sources.tables import stored

#: Half widths of the hue window in degrees, narrow to wide, and shades that a window needs.
WIDTHS, POOL_MIN = (22.0, 28.0, 34.0, 40.0, 46.0, 52.0), 80
#: Shades that name the word before their mean hue replaces the word's own, and shades that a level must keep.
TEXT_MIN, KEPT_MIN = 35, 30
# Fixed relaxation levels: smallest L, largest C, upper C quantile, C margin over its target quantile.
LEVELS = ((45.0, 55.0, 0.55, 10.0), (40.0, 65.0, 0.65, 16.0), (37.0, 73.0, 0.75, 20.0))
L_MAX, C_MIN = 78.0, 10.0
L_BAND, C_LOW, C_TARGET, L_TARGET = (0.35, 0.85), 0.20, 0.35, 0.55
C_WEIGHT, C_TILT, SHORTLIST = 0.9, 0.12, 40


def _r(x: Column) -> Column:
    """Rounded, so that interpolated bounds compare alike everywhere."""
    return F.round(x, 6)


def reference_hues(shades: DataFrame, keys: DataFrame) -> DataFrame:
    """key, hue_ref, n_text: the mean hue of shades whose names hold the key, if enough do, else the key's own hue."""
    items = shades.select("hue", F.concat_ws(" ", "product_name", "shade_name").alias("body"))
    named = relational.word_matches(items, keys, "body", few=True)
    means = aggregates.hue_means(named, ["key"], "hue").join(named.groupBy("key").agg(F.count("*").alias("n_text")), "key")
    n = F.coalesce("n_text", F.lit(0))
    return keys.join(means, "key", "left").select("key", F.when(n >= TEXT_MIN, F.coalesce("mean_hue", "hue")).otherwise(F.col("hue")).alias("hue_ref"), n.alias("n_text"))


def hue_windows(shades: DataFrame, refs: DataFrame) -> DataFrame:
    """Shades within the narrowest window of each key that holds enough of them; keys without such a window drop out.

    refs is a colour lexicon of bounded size and is broadcast.
    """
    d = _r(color.circ_dist(F.col("hue"), F.col("hue_ref")))
    pairs = shades.crossJoin(F.broadcast(refs)).withColumn("_d", d).where(F.col("_d") <= WIDTHS[-1])
    counts = pairs.groupBy("key").agg(*(F.count_if(F.col("_d") <= w).alias(f"_n{k}") for k, w in enumerate(WIDTHS)))
    first = F.coalesce(*(F.when(F.col(f"_n{k}") >= POOL_MIN, w) for k, w in enumerate(WIDTHS)))
    return pairs.join(F.broadcast(counts.select("key", first.alias("window"))), "key").where(F.col("_d") <= F.col("window")).drop("_d")


def neutral_window(pool: DataFrame) -> DataFrame:
    """Rows of each key (a bounded lexicon, as are its bounds) inside absolute and quantile bounds of L and C, at the first relaxation level that keeps enough, with that level as relax."""
    level = F.array(*(F.struct(F.lit(k).alias("relax"), F.lit(a).alias("l0"), F.lit(b).alias("c1"), F.lit(q).alias("q"), F.lit(m).alias("m")) for k, (a, b, q, m) in enumerate(LEVELS)))
    rows = pool.withColumn("_v", F.explode(level)).where(F.col("L_lab").between(F.col("_v.l0"), L_MAX) & F.col("C_lab").between(C_MIN, F.col("_v.c1")))
    rows = rows.withColumn("relax", F.col("_v.relax"))
    l_q = F.percentile("L_lab", F.array(*map(F.lit, L_BAND)))
    c_q = F.percentile("C_lab", F.array(*map(F.lit, (C_LOW, C_TARGET, *(v[2] for v in LEVELS)))))
    bounds = rows.groupBy("key", "relax").agg(l_q.alias("_l"), c_q.alias("_c"))
    margin = F.element_at(F.array(*(F.lit(v[3]) for v in LEVELS)), F.col("relax") + 1)
    top = F.least(F.element_at("_c", F.col("relax") + 3), F.col("_c")[1] + margin)
    bounds = bounds.select("key", "relax", F.col("_l")[0].alias("_l0"), F.col("_l")[1].alias("_l1"), F.col("_c")[0].alias("_c0"), top.alias("_c1"))
    rows = rows.join(F.broadcast(bounds), ["key", "relax"])
    rows = rows.where(_r(F.col("L_lab")).between(_r(F.col("_l0")), _r(F.col("_l1"))) & _r(F.col("C_lab")).between(_r(F.col("_c0")), _r(F.col("_c1"))))
    enough = rows.groupBy("key", "relax").agg(F.count("*").alias("n_kept")).where(F.col("n_kept") >= KEPT_MIN)
    chosen = enough.groupBy("key").agg(F.min(F.struct("relax", "n_kept")).alias("x")).select("key", "x.relax", "x.n_kept")
    return rows.drop("_v", "_l0", "_l1", "_c0", "_c1").join(F.broadcast(chosen), ["key", "relax"])


def typical_shades(kept: DataFrame) -> DataFrame:
    """key, medoid: of the shades nearest the target L and C (with a mild preference for low chroma), the medoid's hex."""
    targets = kept.groupBy("key").agg(F.percentile("L_lab", L_TARGET).alias("_lt"), F.percentile("C_lab", C_TARGET).alias("_ct"))
    score = F.abs(F.col("L_lab") - F.col("_lt")) + C_WEIGHT * F.abs(F.col("C_lab") - F.col("_ct")) + C_TILT * F.col("C_lab")
    near = relational.top_per(kept.join(F.broadcast(targets), "key").withColumn("_s", _r(score)), ["key"], ["_s", "chip_hex", "shade_id"], SHORTLIST)
    return aggregates.lab_medoids(near, ["key"], "chip_hex", "chip_hex")


def domain_anchors(shades: DataFrame, keys: DataFrame) -> DataFrame:
    """key, hue_ref, n_text, window, n_pool, relax, n_kept, hex of every key (key, hue) that has a window and a level."""
    rows = stored(shades.where("r is not null").select("shade_id", "product_name", "shade_name", "chip_hex", "L_lab", "a_lab", "b_lab", "C_lab", color.hsv_hue(*(F.col(c) / 255 for c in "rgb")).alias("hue")), "hues")
    pool = stored(hue_windows(rows, reference_hues(rows, keys)), "windows")
    kept = stored(neutral_window(pool), "kept")
    sizes = pool.groupBy("key").agg(F.count("*").alias("n_pool"), F.first("window").alias("window"), F.first("hue_ref").alias("hue_ref"), F.first("n_text").alias("n_text"))
    levels = kept.groupBy("key").agg(F.first("relax").alias("relax"), F.first("n_kept").alias("n_kept"))
    return typical_shades(kept).withColumnRenamed("medoid", "hex").join(sizes, "key").join(levels, "key")


def near_best(df: DataFrame, by: str, score: str, chroma: str, value: str, within: float = 0.03) -> DataFrame:
    """by, best: of the rows whose score is within `within` of the group's best, the value with the largest chroma, then score."""
    top = F.max(score).over(Window.partitionBy(by))
    short = df.withColumn("_t", top).where(F.round(F.col(score), 9) >= F.round(F.col("_t") - within, 9))
    return short.groupBy(by).agg(F.max_by(value, F.struct(F.round(chroma, 6), F.round(score, 9), F.col(value))).alias("best"))
