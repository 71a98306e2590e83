"""Anchors of wishes: alias indexes, colour mentions resolved to one anchor, and the typical shades that replace it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color, text
from ..operators import aggregates, relational
from ..sources.tables import stored

# Fixed thresholds of base anchors.
TRIGGER_C, TRIGGER_L, VARIANT_L = 35.0, 78.0, 80.0
VARIANTS_MIN, NEUTRAL_C, NEUTRAL_BAND, VIVID_FROM, NEUTRAL_WEIGHT, NEUTRAL_TOP = 8, 28.0, (0.30, 0.70), 0.60, 0.8, 25
# Fixed thresholds of naming anchors.
MEMBER_P, MEMBERS_MIN, MEMBERS_TOP = 0.55, 40, 250
#: Labels whose members are held to a band around the reference hue, and those that lose their farthest tail.
HUE_LABELS, TRIM_LABELS, HUE_BAND, TRIM = ("purple", "violet", "brown"), ("brown",), 28.0, 0.10
CHROMA_AXES, RAISING = ("saturation", "vibrancy", "chroma"), ("raise", "high", "up", "more")
LIGHT_AXES, LOWERING = ("depth", "brightness"), ("lower", "down", "less")
RANKED_TIE, VOTE_TIE = 0.03, 0.04


def _r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, so that interpolated bounds compare alike everywhere."""
    return F.round(x, digits)


def _with_lab(df: DataFrame) -> DataFrame:
    L, a, b = color.hex_lab(F.col("hex"))
    return df.withColumns({"L_lab": L, "a_lab": a, "b_lab": b}).withColumn("C_lab", F.hypot("a_lab", "b_lab"))


def alias_index(base: DataFrame, extra: DataFrame, shortest: int = 3, least: int = 3) -> DataFrame:
    """alias, source, hex, L_lab, a_lab, b_lab, C_lab, hue of two tables of names (name, hex); extra wins over base.

    A single word of extra stays only if base has it too, or if it is at least as frequent in the phrases
    of both as the upper median word (`least` times at the fewest). Of equal aliases the smallest hex stays.
    """

    def aliases(df: DataFrame, source: str) -> DataFrame:
        alias = text.normalise(F.regexp_replace(F.trim(F.lower("name")), "^xkcd:", ""))
        return df.select(alias.alias("alias"), color.norm_hex(F.col("hex")).alias("hex")).where("alias <> ''").groupBy("alias").agg(F.min("hex").alias("hex")).withColumn("source", F.lit(source))

    one, two = stored(aliases(base, "base"), "aliases-base"), stored(aliases(extra, "extra"), "aliases-extra")
    phrases = one.select("alias").union(two.select("alias")).where("instr(alias, ' ') > 0").distinct()
    frequency = phrases.select(F.explode(F.split("alias", " ")).alias("alias")).groupBy("alias").agg(F.count("*").alias("_f"))
    limit = frequency.agg(F.expr("percentile_disc(0.5) within group (order by _f desc)").alias("_m"))
    marked = two.join(one.select("alias", F.lit(True).alias("_both")), "alias", "left").join(frequency, "alias", "left").crossJoin(F.broadcast(limit))
    often = F.coalesce(F.col("_f"), F.lit(0)) >= F.greatest(F.lit(least), F.col("_m"))
    single = (F.length("alias") >= shortest) & F.col("_m").isNotNull() & (F.coalesce("_both", F.lit(False)) | often)
    chosen = marked.where((F.instr("alias", " ") > 0) | single).select("alias", "hex", "source")
    rows = relational.overlay([chosen, one], "alias")
    return _with_lab(rows).withColumn("hue", color.hsv_hue(*color.hex_rgb01(F.col("hex"))))


def stabilised_bases(index: DataFrame, names: DataFrame) -> DataFrame:
    """key, hex, policy for the single words of a key index (key, medoid).

    A word whose own medoid is pale or light takes the medoid of its variants, the colours of phrases that
    hold it: of a neutral family those in the middle band of chroma nearest the medians, else the vivid ones.
    Words with fewer than 8 variants keep their own. names: (source, name, hex).
    """
    words = _with_lab(index.where("instr(key, ' ') = 0").select("key", F.col("medoid").alias("hex")))
    weak = words.where((_r("C_lab") < TRIGGER_C) | (_r("L_lab") > TRIGGER_L)).select("key")
    rows = names.select("name", "hex").distinct().select(color.norm_hex(F.col("hex")).alias("hex"), text.key(F.col("name")).alias("phrase")).where("hex is not null and instr(phrase, ' ') > 0")
    pairs = rows.select("hex", F.explode(F.array_distinct(F.split("phrase", " "))).alias("key")).distinct()
    v = stored(_with_lab(pairs.join(weak, "key")).where(_r("L_lab") <= VARIANT_L), "variants")
    q = F.percentile("C_lab", F.array(*map(F.lit, (NEUTRAL_BAND[0], 0.5, VIVID_FROM, NEUTRAL_BAND[1]))))
    marks = v.groupBy("key").agg(F.count("*").alias("_n"), q.alias("_c"), F.percentile("L_lab", 0.5).alias("_l")).where(F.col("_n") >= VARIANTS_MIN)
    v = v.join(marks, "key").withColumn("_neutral", _r(F.col("_c")[1]) <= NEUTRAL_C)
    c = _r("C_lab")
    v = stored(v.withColumn("_in", F.when(F.col("_neutral"), c.between(_r(F.col("_c")[0]), _r(F.col("_c")[3]))).otherwise(c >= _r(F.col("_c")[2]))), "marked")
    left = v.groupBy("key").agg(F.count_if("_in").alias("_left"))
    v = v.join(left, "key").where(F.col("_in") | (F.col("_left") < VARIANTS_MIN))
    score = F.abs(F.col("L_lab") - F.col("_l")) + NEUTRAL_WEIGHT * F.abs(F.col("C_lab") - F.col("_c")[1])
    neutral = relational.top_per(v.where("_neutral").withColumn("_s", _r(score)), ["key"], ["_s", "hex"], NEUTRAL_TOP).drop("_s", "rank")
    medoids = aggregates.lab_medoids(neutral.unionByName(v.where("not _neutral")), ["key"], "hex", "hex").withColumnRenamed("medoid", "_m")
    return words.join(medoids, "key", "left").select("key", F.coalesce("_m", "hex").alias("hex"), F.when(F.col("_m").isNotNull(), "variants").otherwise("own").alias("policy"))


def mention_anchors(mentions: DataFrame, candidates: DataFrame, within: float = 0.03) -> DataFrame:
    """text_id, n_colours, plain, token, anchor_hex, anchor_L, anchor_a, anchor_b of mentions (text_id, start, name, kind, polarity, confidence).

    Colours that are liked, neutral or unknown count. candidates (name, score, hex) resolve a name: of those
    near the best score, the most vivid; they are a lexicon, and what it resolves to is broadcast. The most confident mention that resolves is the anchor, the first
    of equals; the token is the first mention's name. Texts without such a mention have no row.
    """
    near = _with_lab(candidates.where("hex is not null"))
    best = near.groupBy("name").agg(F.max("score").alias("_best"))
    near = near.join(best, "name").where(F.col("score").isNull() | F.col("_best").isNull() | (_r("score", 9) >= _r(F.col("_best") - within, 9)))
    lab = F.struct("hex", "L_lab", "a_lab", "b_lab")
    resolved = near.groupBy("name").agg(F.max_by(lab, F.struct(_r("C_lab"), _r(-F.coalesce("score", F.lit(-1e9)), 9), F.col("hex"))).alias("_a"))
    held = mentions.where((F.col("kind") == "color") & F.coalesce("polarity", F.lit("UNKNOWN")).isin("LIKE", "NEUTRAL", "UNKNOWN")).join(F.broadcast(resolved), "name", "left")
    sure = F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("start"), F.col("name"))
    g = held.groupBy("text_id").agg(F.count("*").alias("n_colours"), F.min_by("name", F.struct("start", "name")).alias("token"), F.max_by("_a", F.when(F.col("_a").isNotNull(), sure)).alias("_a"))
    return g.select("text_id", "n_colours", (F.col("n_colours") == 1).alias("plain"), "token", F.col("_a.hex").alias("anchor_hex"), *(F.col(f"_a.{c}_lab").alias(f"anchor_{c}") for c in "Lab"))


def hi_chroma(constraints: DataFrame, ranked: DataFrame | None = None, votes: DataFrame | None = None) -> DataFrame:
    """text_id, hi_chroma: the text's one constraint asks for more chroma, or for brightness where chroma scores nearly as much.

    constraints: text_id, axis, direction. ranked and votes (text_id, axis, score) are the scores of axes by
    similarity and by vote: a tie is within 0.03 of the best axis, or within 0.04 of brightness.
    """
    g = constraints.groupBy("text_id").agg(F.count("*").alias("_n"), F.min("axis").alias("axis"), F.min("direction").alias("direction"))
    hi = F.max(F.when(F.col("axis").isin(*CHROMA_AXES), F.col("score")))
    tie = F.lit(False)
    if ranked is not None:
        g = g.join(ranked.groupBy("text_id").agg((_r(F.max("score") - hi, 9) <= RANKED_TIE).alias("_ranked")), "text_id", "left")
        tie = tie | F.coalesce("_ranked", F.lit(False))
    if votes is not None:
        own = F.max(F.when(F.col("axis") == "brightness", F.col("score")))
        g = g.join(votes.groupBy("text_id").agg((_r(own - hi, 9) <= VOTE_TIE).alias("_votes")), "text_id", "left")
        tie = tie | F.coalesce("_votes", F.lit(False))
    asks = F.col("direction").isin(*RAISING) & (F.col("axis").isin(*CHROMA_AXES) | ((F.col("axis") == "brightness") & tie))
    return g.select("text_id", F.coalesce((F.col("_n") == 1) & asks, F.lit(False)).alias("hi_chroma"))


def members(long: DataFrame) -> DataFrame:
    """Rows (label, p, ...) that stand for a label: p from 0.55 on, or the best 250 of a label with fewer than 40 such; none under 40."""
    sizes = long.where("p > 0").groupBy("label").agg(F.count_if(F.col("p") >= MEMBER_P).alias("_many"), F.count("*").alias("_all")).where(F.col("_all") >= MEMBERS_MIN)
    rows = long.where("p > 0").join(F.broadcast(sizes), "label")  # labels are a bounded list
    many = rows.where((F.col("_many") >= MEMBERS_MIN) & (F.col("p") >= MEMBER_P))
    few = relational.top_per(rows.where(F.col("_many") < MEMBERS_MIN), ["label"], [F.desc("p"), "product_id", "shade_id"], MEMBERS_TOP, "_k").drop("_k")
    return many.unionByName(few).drop("_many", "_all")


def _enough(rows: DataFrame, keep: Column, order: list) -> DataFrame:
    """Rows of each label for which keep holds; its first 40 in the order where fewer do."""
    left = rows.groupBy("label").agg(F.count_if(keep).alias("_left"))
    rows = rows.join(F.broadcast(left), "label")
    first = relational.top_per(rows.where(F.col("_left") < MEMBERS_MIN), ["label"], order, MEMBERS_MIN, "_k").drop("_k")
    return rows.where((F.col("_left") >= MEMBERS_MIN) & keep).unionByName(first).drop("_left")


def _means(rows: DataFrame, w: Column) -> DataFrame:
    return rows.withColumn("_w", w).groupBy("label").agg(F.count("*").alias("n"), *(F.try_divide(F.sum(F.col("_w") * F.col(f"{c}_lab")), F.sum("_w")).alias(f"anchor_{c}") for c in "Lab"))


def _heavy_chroma(rows: DataFrame, q: float) -> DataFrame:
    """label, _t: the chroma at which the share of weight reaches q, to four digits, so that the running sum meets one row for each such chroma."""
    steps = rows.groupBy("label", _r("C_lab", 4).alias("_c")).agg(F.sum("p").alias("_w"))
    over = Window.partitionBy("label")
    steps = steps.withColumn("_share", F.sum("_w").over(over.orderBy("_c")) / F.sum("_w").over(over))
    return steps.groupBy("label").agg(F.min(F.when(_r("_share", 9) >= q, F.col("_c"))).alias("_t"))


def label_anchors(long: DataFrame, references: DataFrame, chroma_q: float | None = None) -> DataFrame:
    """label, n, anchor_L, anchor_a, anchor_b: the typical shade of each label that has 40 members.

    long: label, p, product_id, shade_id, chip_hex, Lab, C; references: label, hue. Weighted means of the
    members; with chroma_q, of those from that weighted quantile of chroma on. Members of purple, violet and
    brown are instead held to the hue of the reference (else of the likeliest member) and weighted by it.
    """
    m = stored(members(long), "members")
    of_hue = F.col("label").isin(*HUE_LABELS)
    plain = m.where(~of_hue)
    if chroma_q is not None:
        plain = plain.join(F.broadcast(_heavy_chroma(plain, chroma_q)), "label")
        plain = _enough(plain, _r("C_lab", 4) >= F.col("_t"), [F.desc(_r("C_lab", 4)), "product_id", "shade_id"])
    h = m.where(of_hue).withColumn("_h", color.hsv_hue(*color.hex_rgb01(F.col("chip_hex"))))
    likeliest = h.groupBy("label").agg(F.max_by("_h", F.struct("p", "product_id", "shade_id")).alias("_own"))
    centre = likeliest.join(references, "label", "left").select("label", F.coalesce("hue", "_own").alias("_h0"))
    h = h.join(F.broadcast(centre), "label").withColumn("_d", _r(color.circ_dist(F.col("_h"), F.col("_h0"))))
    h = stored(_enough(h, F.col("_d") <= HUE_BAND, ["_d", "product_id", "shade_id"]), "hue-members")
    far = h.groupBy("label").agg(_r(F.percentile("_d", 1 - TRIM)).alias("_far"))
    h = h.join(F.broadcast(far), "label")
    inside = ~F.col("label").isin(*TRIM_LABELS) | (F.col("_d") <= F.col("_far"))
    left = h.groupBy("label").agg(F.count_if(inside).alias("_left"))
    h = h.join(F.broadcast(left), "label").where(inside | (F.col("_left") < MEMBERS_MIN))
    near = F.exp(-F.pow(F.col("_d") / (HUE_BAND / 2), F.lit(2.0)))
    return _means(plain, F.col("p")).unionByName(_means(h, F.col("p") * near))


def effective_anchors(found: DataFrame, flags: DataFrame, base: DataFrame, vivid: DataFrame) -> DataFrame:
    """text_id, token, plain, hi_chroma, used, anchor_hex, anchor_L, anchor_a, anchor_b: mention anchors, replaced by the label's typical shade in plain or chroma-seeking wishes.

    base and vivid are label_anchors without and with the chroma quantile 0.9; labels are a bounded list and are broadcast.
    """
    pick = lambda df, name: df.select(F.col("label").alias("token"), F.struct("anchor_L", "anchor_a", "anchor_b").alias(name))
    j = found.join(flags, "text_id", "left").withColumn("hi_chroma", F.coalesce("hi_chroma", F.lit(False)))
    j = j.join(pick(base, "_base"), "token", "left").join(pick(vivid, "_vivid"), "token", "left")
    typical = F.when(F.col("anchor_hex").isNotNull() & (F.col("plain") | F.col("hi_chroma")), F.when(F.col("hi_chroma"), F.col("_vivid")).otherwise(F.col("_base")))
    j = j.withColumn("_t", typical)
    return j.select("text_id", "token", "plain", "hi_chroma", F.col("_t").isNotNull().alias("used"), "anchor_hex", *(F.coalesce(F.col(f"_t.anchor_{c}"), F.col(f"anchor_{c}")).alias(f"anchor_{c}") for c in "Lab"))
