"""Evaluation reports over scored scenarios and candidate pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import aggregates, pools, relational
from ..sources.tables import grown
from . import recommend

# Fixed grid of constraint templates.
TEMPLATES = (
    ("base", ""), ("not_too_bright", "L_lab<=high:0.8"), ("bright", "L_lab>=high:0.8"), ("deep", "depth>=high:0.8"), ("muted", "C_lab<=medium:0.8"), ("vivid", "C_lab>=high:0.8"),
    ("warm", "warmth>=medium:0.6"), ("cool", "warmth<=medium:0.6"), ("nude_like", "C_lab<=medium:0.8;L_lab>=medium:0.4"), ("deep_muted", "depth>=high:0.7;C_lab<=medium:0.6"),
)
FEATURES = ("L_lab", "C_lab", "sat_eff")


def template_scores(spark: SparkSession, shades: DataFrame, prototypes: DataFrame, calibration: DataFrame, k: int = 20) -> DataFrame:
    """The first k shades of every cluster × template; query_id is 10 * cluster_id + template, prototypes: cluster_id, anchor_*."""
    grid = spark.createDataFrame([(t, text) for t, (_, text) in enumerate(TEMPLATES)], "template int, constraints string")
    queries = prototypes.crossJoin(F.broadcast(grid)).withColumn("query_id", F.col("cluster_id") * len(TEMPLATES) + F.col("template"))
    anchors = queries.select("query_id", "anchor_L", "anchor_a", "anchor_b")
    scored = recommend.score_inventory(shades.drop("cluster_id"), anchors, queries.select("query_id", "constraints"), calibration, k=k)
    ids = {"cluster_id": F.floor(F.col("query_id") / len(TEMPLATES)).cast("int"), "template": F.pmod("query_id", F.lit(len(TEMPLATES)))}
    return scored.withColumns(ids)


def golden_rankings(top: DataFrame, k: int = 20) -> DataFrame:
    """scenario_id, cluster_id, template, constraints, topk, keys: what a later run is checked against (relational.golden_check).

    top: the first shades of template_scores. The id is the first 12 hex digits of the SHA-1 of the scenario as
    JSON with sorted names, so that equal scenarios have equal ids.
    """
    keys = relational.goldens(top.withColumn("_s", F.struct("cluster_id", "template")), "_s", F.concat_ws("|", "product_id", "shade_id"), k)
    text = F.element_at(F.array(*(F.lit(t) for _, t in TEMPLATES)), (F.col("_s.template") + 1).cast("int"))
    rows = keys.select(F.col("_s.cluster_id").alias("cluster_id"), F.col("_s.template").alias("template"), text.alias("constraints"), F.lit(k).alias("topk"), "keys")
    payload = F.to_json(F.struct("cluster_id", "constraints", "topk"))
    return rows.select(F.substring(F.sha1(payload.cast("binary")), 1, 12).alias("scenario_id"), "cluster_id", "template", "constraints", "topk", "keys")


def scenario_report(top: DataFrame) -> DataFrame:
    """Means of distance, penalty and features over the first shades of each scenario."""
    means = {"mean_de": "deltaE_norm", "mean_penalty": "constraint_penalty_norm", **{f"mean_{c}": c for c in FEATURES}}
    return top.groupBy("cluster_id", "template").agg(F.count("*").alias("n"), *(F.avg(c).alias(name) for name, c in means.items()))


def cluster_summary(report: DataFrame) -> DataFrame:
    """Over each cluster's scenarios: their number, mean and 0.9 quantile of the mean distance, mean penalty."""
    return report.groupBy("cluster_id").agg(F.count("*").alias("n_scenarios"), F.avg("mean_de").alias("mean_de"), F.percentile("mean_de", 0.9).alias("p90_de"), F.avg("mean_penalty").alias("mean_penalty"))


def shift(report: DataFrame, base: int = 0) -> DataFrame:
    """Feature means of each scenario less those of its cluster's base template."""
    names = ("mean_de", "mean_penalty", *(f"mean_{c}" for c in FEATURES))
    b = report.where(F.col("template") == base).select("cluster_id", *(F.col(n).alias(f"_{n}") for n in names))
    return report.where(F.col("template") != base).join(b, "cluster_id").select("cluster_id", "template", *((F.col(n) - F.col(f"_{n}")).alias(n.replace("mean_", "d_")) for n in names))


def overlap(top: DataFrame, base: int = 0) -> DataFrame:
    """cluster_id, template, n_shared: shades that a scenario's first ones share with the base template's."""
    b = top.where(F.col("template") == base).select("cluster_id", "product_id", "shade_id", F.lit(1).alias("_b"))
    return top.where(F.col("template") != base).join(b, ["cluster_id", "product_id", "shade_id"], "left").groupBy("cluster_id", "template").agg(F.count("_b").alias("n_shared"))


def hue_coverage(shades: DataFrame, anchors: DataFrame, angle: float = 25.0, k: int = 20, factor: int = 5) -> DataFrame:
    """query_id, n_close, status: shades within the angle of the anchor's Lab hue; PASS from factor * k on. anchors is bounded and broadcast."""
    a = anchors.select("query_id", F.degrees(F.atan2(F.round("anchor_b", 10), F.round("anchor_a", 10))).alias("_h"))
    d = F.round(color.circ_dist(F.col("H_lab_deg"), F.col("_h")), 6)
    n = relational.with_colour(shades).crossJoin(F.broadcast(a)).groupBy("query_id").agg(F.count_if(d <= angle).alias("n_close"))
    return n.withColumn("status", F.when(F.col("n_close") >= factor * k, "PASS").otherwise("FAIL"))


def pool_sizes(pairs: DataFrame) -> DataFrame:
    """query_id, n_all, n_pool: eligible shades and those of the hard pool, 0 included."""
    n = pools.hard_pool(pairs).groupBy("query_id").agg(F.count("*").alias("_n"))
    return pairs.groupBy("query_id").agg(F.count("*").alias("n_all")).join(n, "query_id", "left").select("query_id", "n_all", F.coalesce("_n", F.lit(0)).alias("n_pool"))


def poorly_covered(pairs: DataFrame, least: int = 20, k: int = 10) -> DataFrame:
    """The k nearest shades of each anchor with fewer than `least` shades within its threshold."""
    few = pools.coverage(pairs).where(F.col("n_within") < least).select("query_id")
    return relational.top_per(pairs.join(few, "query_id"), ["query_id"], [F.round("de00", 9), "product_id", "shade_id"], k)


def neutrality(top: DataFrame, catalogue: DataFrame, queries: DataFrame, share: float = 0.25, angle: float = 35.0) -> DataFrame:
    """query_id, status, c_extreme, l_extreme, hue_drift, low_coverage, failed: of each query's first shades, the shares in the catalogue's chroma and lightness tails and the median hue distance to the anchor.

    top: query_id, L_lab, a_lab, b_lab, C_lab, anchor_a, anchor_b, low_coverage; catalogue: L_lab, C_lab. A query without shades is EMPTY and fails.
    """
    tails = aggregates.tails(catalogue).toDF("_c90", "_l10", "_l90")
    angle_of = lambda b, a: F.degrees(F.atan2(F.round(b, 10), F.round(a, 10)))
    drift = color.circ_dist(angle_of("b_lab", "a_lab"), angle_of("anchor_b", "anchor_a"))
    rows = top.crossJoin(F.broadcast(tails)).select("query_id", "low_coverage", (F.col("C_lab") > F.col("_c90")).cast("double").alias("c"), ((F.col("L_lab") < F.col("_l10")) | (F.col("L_lab") > F.col("_l90"))).cast("double").alias("l"), drift.alias("d"))
    g = rows.groupBy("query_id").agg(F.avg("c").alias("c_extreme"), F.avg("l").alias("l_extreme"), F.percentile("d", 0.5).alias("hue_drift"), F.max("low_coverage").alias("low_coverage"))
    g = queries.select("query_id").join(g, "query_id", "left").withColumn("status", F.when(F.col("c_extreme").isNull(), "EMPTY").otherwise("OK"))
    failed = (F.col("status") != "OK") | (F.col("c_extreme") >= share) | (F.col("l_extreme") >= share) | (~F.col("low_coverage") & (F.round("hue_drift", 6) >= angle))
    return g.withColumn("failed", F.coalesce(failed, F.lit(False)))


def anchor_grid(found: DataFrame, forms: DataFrame) -> DataFrame:
    """token, n_texts, n_forms, n_anchors, status: whether each colour word resolves to one anchor in every sentence form. found: text_id, token, anchor_hex; forms: text_id, form."""
    g = found.join(grown(forms), "text_id").groupBy("token").agg(F.count("*").alias("n_texts"), F.count_distinct("form").alias("n_forms"), F.count_distinct("anchor_hex").alias("n_anchors"))
    return g.withColumn("status", F.when(F.col("n_anchors") == 1, "PASS").otherwise("FAIL"))


def anchor_effects(base: DataFrame, vivid: DataFrame) -> DataFrame:
    """label, d_chroma, delta_e, status of label anchors and their chroma-seeking form: chroma does not fall, and the difference is finite."""
    v = vivid.select("label", *(F.col(f"anchor_{c}").alias(f"_{c}") for c in "Lab"))
    j = color.with_delta_e00(base.join(v, "label"), ("anchor_L", "anchor_a", "anchor_b"), ("_L", "_a", "_b"), "delta_e")
    j = j.withColumn("d_chroma", F.hypot("_a", "_b") - F.hypot("anchor_a", "anchor_b"))
    ok = (F.round("d_chroma", 6) >= 0) & ~F.isnan("delta_e")
    return j.select("label", "d_chroma", "delta_e", F.when(ok, "PASS").otherwise("FAIL").alias("status"))
