"""Scores, within-family factors and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, stats
from ..sources.calibration import DELTA_E_REF, PREFERENCE_WEIGHTS, QUANTILES, SCALE_IQR
from . import constraints as con
from . import relational
from .relational import first_per, ranked

CONSTRAINT_GAIN, TILT_GAIN = 4.0, 0.6


def gate(p: Column, p_min: float = 0.55, p_hi: float = 0.75) -> Column:
    """How far a membership probability counts."""
    p_hi = p_hi if p_hi > p_min else min(0.9, p_min + 0.1)
    return stats.smoothstep(stats.clip((p - p_min) / (p_hi - p_min), 0, 1))


def quantile_at(q: Column, at: Column) -> Column:
    """The quantile of the array (in the order of QUANTILES) nearest to `at`, the lower one on ties."""
    grid = F.array(*(F.struct(F.round(F.abs(F.lit(x) - at), 12).alias("d"), F.lit(k + 1).alias("k")) for k, x in enumerate(QUANTILES)))
    return F.element_at(q, F.array_min(grid)["k"])


def spec_score(value: Column, axis: Column, direction: Column, q: Column, q_lo: Column, q_hi: Column, q_target: Column, q_span: Column) -> Column:
    """Score in 0..1 of a value for one within-family wish: above, below, near or toward."""
    return _shaped_score(value, direction, spec_shape(axis, direction, q, q_lo, q_hi, q_target, q_span))


def spec_shape(axis: Column, direction: Column, q: Column, q_lo: Column, q_hi: Column, q_target: Column, q_span: Column) -> dict[str, Column]:
    """What a wish's score takes from its distribution, whatever the value."""
    q25, q50, q75 = (quantile_at(q, F.lit(x)) for x in (0.25, 0.5, 0.75))
    scale = F.greatest(F.lit(0.001), F.abs(q75 - q25) / 2)
    band = F.greatest(F.lit(1e-6), F.abs(quantile_at(q, q_hi) - quantile_at(q, q_lo)))
    k = stats.clip(band / scale, 0.6, 2.5)
    centre = quantile_at(q, q_target)
    span = stats.clip(q_span, 0.01, 0.49)
    half = F.abs(quantile_at(q, F.least(F.lit(0.99), q_target + span)) - quantile_at(q, F.greatest(F.lit(0.01), q_target - span))) / 2
    hue = (axis == "h") & (direction == "toward")
    radius = F.when(hue, F.greatest(F.lit(10.0), half)).otherwise(F.greatest(F.lit(1e-6), half))
    return {"k": k, "q50": q50, "scale": scale, "centre": centre, "radius": radius, "hue": hue}


def _shaped_score(value: Column, direction: Column, s) -> Column:
    """s: the columns of spec_shape by name, or a struct of them."""
    away = F.when(s["hue"], color.circ_dist(value, s["centre"])).otherwise(F.abs(value - s["centre"]))
    near = stats.smoothstep(1 - stats.clip(away / s["radius"], 0, 1))
    return F.when(direction == "above", stats.sigmoid(s["k"] * (value - s["q50"]) / s["scale"])).when(direction == "below", stats.sigmoid(s["k"] * (s["q50"] - value) / s["scale"])).otherwise(near)


def family_factor(rows: DataFrame, specs: DataFrame, distributions: DataFrame, floor: float = 0.55, p: str = "p") -> DataFrame:
    """rows (query_id, label, p, L_lab, C_lab, H_lab_deg) with `family_factor` of their query's specs.

    specs: query_id, label, axis (L, C, h), direction, strength, q_lo, q_hi, q_target, q_span; a bounded list of wishes, broadcast to the rows.
    """
    joined = specs.join(distributions, ["label", "axis"])
    shape = spec_shape(*(F.col(f"_s.{c}") for c in ("axis", "direction", "q", "q_lo", "q_hi", "q_target", "q_span")))
    joined = joined.select("query_id", F.struct("axis", "direction", "strength", "q", "q_lo", "q_hi", "q_target", "q_span").alias("_s"))
    joined = joined.withColumn("_shape", F.struct(*(c.alias(n) for n, c in shape.items())))  # once for each wish, not for each row
    packed = joined.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_s", "_shape"))).alias("_specs"))

    def one(x: Column) -> Column:
        s = x["_s"]
        value = F.when(s["axis"] == "L", F.col("L_lab")).when(s["axis"] == "C", F.col("C_lab")).otherwise(F.col("H_lab_deg"))
        score = _shaped_score(value, s["direction"], x["_shape"])
        strength = stats.clip(s["strength"], 0, 1)
        return 1 - strength + strength * (floor + (1 - floor) * score)

    out = rows.join(F.broadcast(packed), "query_id", "left")
    product = F.aggregate(F.transform("_specs", one), F.lit(1.0), lambda a, x: a * x)
    return out.withColumn("family_factor", F.when(F.col("_specs").isNotNull(), stats.clip(1 - gate(F.col(p)) + gate(F.col(p)) * product, 0, 1))).drop("_specs")


# Fixed bands of a within-family wish by direction and strength, and the weight of a strength.
BANDS = {
    "raise": {"weak": (0.45, 0.65), "med": (0.50, 0.75), "strong": (0.60, 0.85)},
    "lower": {"weak": (0.35, 0.55), "med": (0.25, 0.50), "strong": (0.15, 0.40)},
}
FAMILY_WEIGHT = {"weak": 0.6, "med": 0.85, "strong": 1.0}


def snapped_band(low: float, high: float) -> tuple[float, float]:
    """Both ends at the nearest quantile that distributions have, the lower one on ties; an empty band ends one quantile higher."""
    at = lambda x: min(range(len(QUANTILES)), key=lambda k: (round(abs(QUANTILES[k] - x), 12), k))
    i, j = at(low), at(high)
    return QUANTILES[i], QUANTILES[j if j > i else min(i + 1, len(QUANTILES) - 1)]


def family_specs(prefs: DataFrame) -> DataFrame:
    """Specs of (query_id, label, axis, direction, strength): brightness wishes on L, saturation and vibrancy on C, their bands by direction and strength (other strengths count as med)."""
    axis = F.when(F.col("axis") == "brightness", "L").when(F.col("axis").isin("saturation", "vibrancy"), "C")
    strength = F.when(F.col("strength").isin(*FAMILY_WEIGHT), F.col("strength")).otherwise("med")
    bands = {(d, s): snapped_band(*band) for d, of in BANDS.items() for s, band in of.items()}
    end = lambda k: con.lookup({key: band[k] for key, band in bands.items()}, F.col("direction"), strength)
    return prefs.where(axis.isNotNull() & F.col("direction").isin(*BANDS)).select(
        "query_id", "label", axis.alias("axis"), F.when(F.col("direction") == "raise", "above").otherwise("below").alias("direction"), con.lookup(FAMILY_WEIGHT, strength).alias("strength"),
        end(0).alias("q_lo"), end(1).alias("q_hi"), F.lit(0.5).alias("q_target"), F.lit(0.25).alias("q_span"),
    )


def centres(queries: DataFrame, prototypes: DataFrame, pool: DataFrame) -> DataFrame:
    """queries (query_id, cluster_id, anchor_L, anchor_a, anchor_b) with their centre and its kind: the anchor if it is whole, else the cluster's prototype, else the mean of the query's pool."""
    lab = ("L", "a", "b")
    p = prototypes.select("cluster_id", *(F.col(f"{c}_lab").alias(f"_p{c}") for c in lab))
    m = pool.groupBy("query_id").agg(*(F.avg(f"{c}_lab").alias(f"_m{c}") for c in lab))
    j = queries.join(p, "cluster_id", "left").join(m, "query_id", "left")
    whole = lambda lead: F.col(f"{lead}L").isNotNull() & F.col(f"{lead}a").isNotNull() & F.col(f"{lead}b").isNotNull()
    kind = F.when(whole("anchor_"), "anchor").when(whole("_p"), "prototype").when(whole("_m"), "pool")
    pick = lambda c: F.when(kind == "anchor", F.col(f"anchor_{c}")).when(kind == "prototype", F.col(f"_p{c}")).otherwise(F.col(f"_m{c}"))
    return j.select("query_id", "cluster_id", kind.alias("centre"), *(pick(c).alias(f"anchor_{c}") for c in lab))


def preference_score() -> Column:
    """Minus the weighted distance to the anchor in lightness, chroma and hue."""
    hue = color.circ_diff(F.col("H_lab_deg"), color.hue_deg(F.col("anchor_a"), F.col("anchor_b"))) / 180
    parts = (F.col("L_lab") - F.col("anchor_L")) / SCALE_IQR["L_lab"], (F.col("C_lab") - F.hypot("anchor_a", "anchor_b")) / SCALE_IQR["C_lab"], hue
    return -sum(abs(PREFERENCE_WEIGHTS[k]) * F.abs(x) for k, x in zip("LCH", parts))


def score(pool: DataFrame, constraints: DataFrame, calibration: DataFrame, lambda_c: float = 1.0, lambda_p: float = 0.0, factor: str | None = None, family_mode: str = "reference", snap: bool = True, catalogue: DataFrame | None = None) -> DataFrame:
    """Ranked scores of every pool row (query_id, anchor, shade) under its query's constraints: score_rows, then rank_scores."""
    return rank_scores(score_rows(pool, constraints, calibration, lambda_c, lambda_p, factor, family_mode, snap, catalogue))


def score_rows(pool: DataFrame, constraints: DataFrame, calibration: DataFrame, lambda_c: float = 1.0, lambda_p: float = 0.0, factor: str | None = None, family_mode: str = "reference", snap: bool = True, catalogue: DataFrame | None = None) -> DataFrame:
    """Scores of every pool row (query_id, anchor, shade) under its query's constraints.

    Relative thresholds come from each query's pool, which is capped, or from a catalogue that is every query's pool.
    factor names a column that multiplies the score (NULL: 1). With family_mode "penalty", a negative
    score is divided by it instead, so that a smaller factor never moves a row up.
    """
    if snap:
        constraints = con.snap_cutpoints(pool if catalogue is None else catalogue, constraints, calibration, shared=catalogue is not None)
    resolved = con.thresholds(pool, constraints, calibration) if catalogue is None else con.thresholds(catalogue, constraints, calibration, shared=True)
    out = con.apply_constraints(pool, resolved, shared=catalogue is not None)
    de = color.delta_e76(F.col("L_lab"), F.col("a_lab"), F.col("b_lab"), F.col("anchor_L"), F.col("anchor_a"), F.col("anchor_b"))
    out = out.withColumns({"deltaE": de, "preference_score": preference_score() if lambda_p else F.lit(0.0)}).withColumn("deltaE_norm", F.col("deltaE") / DELTA_E_REF)
    s = -F.col("deltaE_norm") + F.col("preference_score") * lambda_p - F.col("constraint_penalty_norm") * (CONSTRAINT_GAIN * lambda_c) + F.col("constraint_tilt_norm") * (CONSTRAINT_GAIN * lambda_c * TILT_GAIN)
    out = out.withColumn("score", s)
    if factor:
        f = F.coalesce(F.col(factor), F.lit(1.0))
        times = F.col("score") * f
        out = out.withColumn("score", F.when(F.col("score") < 0, F.try_divide(F.col("score"), f)).otherwise(times) if family_mode == "penalty" else times)
    return out


def rank_scores(scored: DataFrame, by: str = "score") -> DataFrame:
    """Rows in score order, then ids; of equal (url, shade_name) the first stays; ranked from 1."""
    order = [F.desc_nulls_last(by), "product_id", "shade_id"]
    return ranked(first_per(scored, ["query_id", "url", "shade_name"], order), ["query_id"], order)


def blend(scored: DataFrame) -> DataFrame:
    """score_total: score minus the weighted anchor distance, which weighs more for constrained and dull anchors. Needs `constrained`."""
    w = F.when(F.col("constrained") & (F.col("anchor_C") < 25), 2.25).when(F.col("constrained"), 1.5).otherwise(0.75)
    return scored.withColumn("score_total", F.col("score") - w * F.col("deltaE_norm"))


def typical_rerank(scored: DataFrame, near: int = 200, least: int = 30, gain: float = 2.5) -> DataFrame:
    """score plus gain times minus the distance to the median of the rows nearest the anchor, for queries with enough rows."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy("deltaE", "product_id", "shade_id")
    close = scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= near)
    median = close.groupBy("query_id").agg(F.count("*").alias("_rows"), *(F.percentile(c, 0.5).alias(f"_{c}") for c in ("L_lab", "a_lab", "b_lab"))).where(F.col("_rows") >= least)
    d = color.delta_e76(*(F.col(c) for c in ("L_lab", "a_lab", "b_lab", "_L_lab", "_a_lab", "_b_lab")))
    out = scored.join(median, "query_id", "left").withColumn("score_typical", F.col("score") - F.coalesce(d * gain, F.lit(0.0)))
    return out.drop("_rows", "_L_lab", "_a_lab", "_b_lab")


def family_qa(rows: DataFrame, by: str, p: str = "p", least: float = 0.55, best: int = 10, worst: int = 5) -> DataFrame:
    """The members (p >= least) of each group that stand first and last by p times family_factor: side (top or worst), rank, weighted."""
    m = rows.where(F.col(p) >= least).withColumn("weighted", F.round(F.col(p) * F.coalesce("family_factor", F.lit(1.0)), 12))
    ids = ["product_id", "shade_id"]
    side = lambda name, order, k: relational.top_per(m, [by], [order, *ids], k).withColumn("side", F.lit(name))
    return side("top", F.desc("weighted"), best).unionByName(side("worst", F.asc("weighted"), worst))


def naive_rule(text: Column) -> Column:
    """Keyword score of a shade for a wish: deep is dark, bright is light, soft is dull, nude is near hue 30."""
    # fixed rule
    rules = (("deep", (100 - F.col("L_lab")) * 0.01), ("bright", F.col("L_lab") * 0.01), ("soft", -F.col("C_lab") * 0.01), ("nude", -F.abs(F.col("H_lab_deg") - 30) * 0.001))
    return sum((F.when(F.lower(text).contains(w), x).otherwise(F.lit(0.0)) for w, x in rules), F.lit(0.0))


def explain_flags(constrained: Column) -> Column:
    """Up to three reasons of a result: the difference in HSV hue of the chip and the anchor's hex (neither NULL), the normalised distance, and, of constrained queries, a small penalty."""
    hue = color.circ_dist(color.hsv_hue(*(F.col(c) / 255 for c in "rgb")), F.col("anchor_hue"))
    flags = F.array(
        F.concat(F.lit("Hue Δ"), F.round(hue).cast("int").cast("string"), F.lit("°")), F.concat(F.lit("ΔE "), F.format_string("%.2f", F.round("deltaE_norm", 2))),
        F.when(constrained & (F.col("constraint_penalty_norm") <= 0.05), F.lit("Good constraint fit")),
    )
    return F.array_compact(flags)
