"""Offline jobs: colour lexicon, naming anchors, distributions, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color, text
from ..operators import aggregates, pools, relational
from ..sources.calibration import QUANTILES
from ..sources.tables import grown, stored


def key_index(names: DataFrame) -> DataFrame:
    """key, name, n_hex, n_sources, confidence, medoid hex, n_phrase, n_prefix of (source, name, hex) rows.

    Repeated rows count once and keys are made once: every part reads the stored distinct rows, and both passes of the medoids the stored chips.
    """
    rows = names.select("source", "name", "hex").distinct().select("source", "name", color.norm_hex(F.col("hex")).alias("hex"), text.key(F.col("name")).alias("key"))
    rows = stored(rows.where("hex is not null and key <> ''"), "keyed")
    L, a, b = color.hex_lab(F.col("hex"))
    chips = stored(rows.select("key", "hex").distinct().withColumns({"L_lab": L, "a_lab": a, "b_lab": b}), "chips")
    medoid = aggregates.lab_medoids(chips, ["key"], "hex", "hex")
    keys = rows.groupBy("key").agg(F.count_distinct("hex").alias("n_hex"), F.count_distinct("source").alias("n_sources"), F.min(F.struct("source", "name", "hex")).alias("f"))
    phrases = rows.select("key").distinct().withColumn("w", F.split("key", " ")).where(F.size("w") > 1)
    within = phrases.select(F.explode(F.array_distinct("w")).alias("key")).groupBy("key").agg(F.count("*").alias("n_phrase"))
    prefix = phrases.select(F.col("w")[0].alias("key")).groupBy("key").agg(F.count("*").alias("n_prefix"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return keys.join(medoid, "key").join(within, "key", "left").join(prefix, "key", "left").select("key", F.col("f.name").alias("name"), "n_hex", "n_sources", F.least("n_hex", "n_sources").alias("confidence"), "medoid", zero("n_phrase"), zero("n_prefix"))


def derived_aliases(index: DataFrame) -> DataFrame:
    """alias, key: base forms of the index's keys (key) without -ish and -s that the index lacks, each of its smallest key; -y is never stripped."""
    forms = index.select("key", F.explode(text.variants(F.col("key"))).alias("alias")).where("alias <> key")
    forms = forms.where(~(F.col("key").endswith("y") & (F.concat("alias", F.lit("y")) == F.col("key"))))
    new = forms.join(index.select(F.col("key").alias("alias")), "alias", "left_anti")
    return new.groupBy("alias").agg(F.min("key").alias("key"))


def resolve(queries: DataFrame, index: DataFrame, axis_words: DataFrame, stop_words: DataFrame, cutoff: float = 75.0, single_cutoff: float = 92.0, min_len: int = 6) -> DataFrame:
    """query_id, alias, stage, score of queries (query_id, text) in a colour index: 1 exact, 2 variant, 3 fuzzy; queries without a match are left out.

    index: key, confidence, n_sources, n_hex, n_phrase, role. Stop words (word) match nothing; axis words (word) only where the index has
    strong evidence; single descriptors (role) nothing. Fuzzy matches need single_cutoff and min_len letters of a
    single word, cutoff else, and a single one enough evidence. Each distinct text is resolved once and joined to its queries,
    so that no table of queries is broadcast; query_id is unique.
    """
    told = queries.select("query_id", "text")
    texts = told.select("text").distinct()
    found = stored(_resolved(texts.select(F.col("text").alias("query_id"), "text"), index, axis_words, stop_words, cutoff, single_cutoff, min_len), "resolved").withColumnRenamed("query_id", "text")
    met = F.broadcast(found) if found.count() <= pools.GROUP_QUERIES else grown(found)
    return told.join(met, "text").select("query_id", "alias", "stage", "score")


def _resolved(queries: DataFrame, index: DataFrame, axis_words: DataFrame, stop_words: DataFrame, cutoff: float, single_cutoff: float, min_len: int) -> DataFrame:
    """resolve, step by step for every query."""
    from ..functions import udf

    q = stored(queries.select("query_id", text.key(F.col("text")).alias("q")).where("q <> ''"), "asked")
    q = q.join(stop_words.select(F.col("word").alias("q")), "q", "left_anti").withColumn("single", ~F.col("q").contains(" "))
    plain = F.coalesce(F.col("role"), F.lit("")) != "descriptor"
    strong = plain & ((F.col("confidence") >= 3) | (F.col("n_phrase") >= 5) | ((F.col("n_sources") >= 3) & (F.col("n_hex") >= 2)))
    enough = plain & F.when(F.col("confidence") > 0, F.col("confidence") >= 2).otherwise((F.col("n_sources") >= 2) & (F.col("n_hex") >= 2))
    keys = index.select("key", plain.alias("_plain"), strong.alias("_strong"), enough.alias("_enough"))
    axis = axis_words.select(F.col("word").alias("q"), F.lit(True).alias("_axis")).distinct()
    weak = q.join(axis, "q").join(keys.where("_strong").select(F.col("key").alias("q")), "q", "left_anti")
    q = q.join(weak.select("query_id"), "query_id", "left_anti")
    exact = q.join(keys, F.col("q") == F.col("key"))
    variant = q.where("single").withColumn("v", F.explode(text.variants(F.col("q")))).where("v <> q").join(keys, F.col("v") == F.col("key"))
    variant = relational.first_per(variant, ["query_id"], [F.length("v"), "v"])
    told = exact.select("query_id", "key", F.lit(1).alias("stage"), F.lit(100.0).alias("score"), (~F.col("single") | F.col("_plain")).alias("ok"))
    told = told.unionByName(variant.select("query_id", "key", F.lit(2).alias("stage"), F.lit(99.0).alias("score"), F.col("_plain").alias("ok")))
    rest = q.join(told.select("query_id"), "query_id", "left_anti").where(~F.col("single") | (F.length("q") >= min_len))
    match = lambda single, least, cut: udf.fuzzy_matches(rest.where(F.col("single") == single).select(F.col("q").alias("word")), keys.select("key"), cut, least, single)
    near = match(True, min_len, single_cutoff).unionByName(match(False, 1, cutoff))
    near = rest.join(near, F.col("q") == F.col("word")).drop("word").join(keys, "key")
    near = relational.first_per(near, ["query_id"], [F.desc("ratio"), "key"]).select("query_id", "key", F.lit(3).alias("stage"), F.col("ratio").alias("score"), (~F.col("single") | F.col("_enough")).alias("ok"))
    return relational.first_per(told.unionByName(near), ["query_id"], ["stage"]).where("ok").select("query_id", F.col("key").alias("alias"), "stage", "score")


def modifier_like(index: DataFrame, phrase: int = 18, prefix: int = 14, share: float = 0.8, most: int = 2) -> DataFrame:
    """Single words that mostly begin other names and have little evidence of their own."""
    few = (F.col("confidence") <= most) & (F.col("n_sources") <= most) & (F.col("n_hex") <= most)
    return index.where((F.instr("key", " ") == 0) & (F.col("n_phrase") >= phrase) & (F.col("n_prefix") >= prefix) & (F.try_divide("n_prefix", "n_phrase") >= share) & few)


def build_lexicon(names: DataFrame, denied: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(lexicon, dropped): the key index without denied and modifier-like keys."""
    index = relational.without_keys(key_index(names), denied, "key")
    dropped = modifier_like(index, **limits)
    return index.join(dropped.select("key"), "key", "left_anti"), dropped


def descriptors(index: DataFrame, names: DataFrame, phrases: int = 10, hexes: int = 6) -> DataFrame:
    """Words of many phrases with the medoid of their muted, medium-light variants."""
    rows = names.select(color.norm_hex(F.col("hex")).alias("hex"), text.key(F.col("name")).alias("key")).where("hex is not null and key like '% %'")
    L, a, b = color.hex_lab(F.col("hex"))
    v = rows.select(F.explode(F.array_distinct(F.split("key", " "))).alias("word"), "hex").distinct().withColumns({"L_lab": L, "a_lab": a, "b_lab": b}).withColumn("C_lab", F.hypot("a_lab", "b_lab"))
    v = v.where(F.col("L_lab").between(35, 85) & (F.col("C_lab") <= 45))
    over = Window.partitionBy("word")
    v = v.withColumns({"_q": F.percentile("C_lab", 0.75).over(over), "_n": F.count("*").over(over)})
    v = v.withColumn("_left", F.count_if(F.col("C_lab") <= F.col("_q")).over(over)).where((F.col("_n") >= hexes) & ((F.col("C_lab") <= F.col("_q")) | (F.col("_left") < hexes)))
    words = index.where(F.col("n_phrase") >= phrases).select(F.col("key").alias("word"))
    return aggregates.lab_medoids(v.join(words, "word"), ["word"], "hex", "hex")


def naming_anchors(long: DataFrame, least: float = 0.55, few: int = 40, top: int = 250) -> DataFrame:
    """label, n, anchor_*: weighted mean of the members; of the best `top` where those are fewer than `few`; none under `few`."""
    over = Window.partitionBy("label")
    m = long.where("p > 0").withColumns({"_many": F.count_if(F.col("p") >= least).over(over), "_n": F.row_number().over(over.orderBy(F.desc("p"), "product_id", "shade_id"))})
    m = m.where(F.when(F.col("_many") >= few, F.col("p") >= least).otherwise(F.col("_n") <= top))
    mean = lambda c: F.try_divide(F.sum(F.col("p") * F.col(c)), F.sum("p")).alias(f"anchor_{c[0]}")
    return m.groupBy("label").agg(F.count("*").alias("n"), mean("L_lab"), mean("a_lab"), mean("b_lab")).where(F.col("n") >= few)


def label_distributions(long: DataFrame, least: float = 0.55, rows: int = 30) -> DataFrame:
    """label, n, axis, q: quantiles of the members' L, C and hue."""
    return aggregates.quantiles(long.where(F.col("p") >= least), ["label"], ["L_lab", "C_lab", "H_lab_deg"], QUANTILES).where(F.col("n") >= rows)


def pivot_labels(names: DataFrame, least: int = 5, pivots: int = 8) -> DataFrame:
    """Rows (label, L_lab, a_lab, b_lab) with the nearest frequent label; none if there are too few pivots."""
    often = names.groupBy("label").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("label")
    p = stored(aggregates.median_lab(names.join(often, "label"), ["label"]), "pivots")
    p = p.crossJoin(F.broadcast(p.agg(F.count("*").alias("_all")))).where(F.col("_all") >= pivots).drop("_all")
    return relational.nearest(names, p, ["L_lab", "a_lab", "b_lab"], "label")


def build_calibration(shades: DataFrame, prototypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reference, dims): the 0.95 quantile of distances to the own prototype; and of each dimension its four thresholds, IQR and deviation, NULL where degenerate."""
    p = prototypes.select("cluster_id", *(F.col(c).alias(f"{c}_p") for c in ("L_lab", "a_lab", "b_lab")))
    d = color.delta_e76(*(F.col(c) for c in ("L_lab", "a_lab", "b_lab", "L_lab_p", "a_lab_p", "b_lab_p")))
    reference = aggregates.exact_quantiles(shades.join(p, "cluster_id").select(d.alias("d")), [], "d", (0.95,)).select(F.col("q")[0].alias("deltaE_ref"))
    long = shades.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dim"), F.col(c).alias("v")) for c in color.SCORING_DIMS))).alias("x")).select("x.*")
    q = aggregates.exact_quantiles(long, ["dim"], "v", (0.25, 0.75, 0.35, 0.5, 0.65, 0.8)).select("dim", "q")
    some = lambda x: F.when(x > 1e-12, x)
    dims = long.groupBy("dim").agg(F.stddev_pop("v").alias("s")).join(q, "dim").select("dim", *(F.col("q")[k + 2].alias(n) for k, n in enumerate(("low", "medium", "high", "very_high"))), some(F.col("q")[1] - F.col("q")[0]).alias("iqr"), some(F.col("s")).alias("std"))
    return reference, dims


def prototypes(shades: DataFrame, starts: DataFrame, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(prototypes, assignments): clusters in Lab by Lloyd's rounds from stated starting points (cluster_id, L_lab, a_lab, b_lab).

    prototypes: cluster_id, L_lab, a_lab, b_lab, n; assignments: product_id, shade_id, cluster_id. A shade belongs to the nearest centre,
    the smallest cluster_id on ties; a cluster without shades keeps its centre. Rounds end when no centre moves by 1e-9, or after
    `rounds`. The rows of starts come to the driver; shades without a colour have no cluster.
    """
    lab = ("L_lab", "a_lab", "b_lab")
    rows = shades.where(F.col("L_lab").isNotNull())
    chips = stored(rows.groupBy(*lab).agg(F.count("*").alias("n")), "chips")
    centres = {r["cluster_id"]: tuple(float(r[c]) for c in lab) for r in starts.collect()}

    def nearest() -> Column:
        away = (F.struct(F.round(sum((F.col(c) - x) * (F.col(c) - x) for c, x in zip(lab, centre)), 9).alias("d"), F.lit(k).alias("k")) for k, centre in sorted(centres.items()))
        return F.array_min(F.array(*away))["k"]

    counts = {}
    for _ in range(rounds if centres else 0):
        got = chips.withColumn("k", nearest()).groupBy("k").agg(F.sum("n").alias("n"), *((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in lab)).collect()
        new = centres | {r["k"]: tuple(r[c] for c in lab) for r in got}
        still = all(abs(x - y) <= 1e-9 for k in centres for x, y in zip(centres[k], new[k]))
        centres, counts = new, {r["k"]: r["n"] for r in got}
        if still:
            break
    table = shades.sparkSession.createDataFrame([(k, *c, counts.get(k, 0)) for k, c in sorted(centres.items())], "cluster_id int, L_lab double, a_lab double, b_lab double, n long")
    return table, rows.select("product_id", "shade_id", nearest().alias("cluster_id")) if centres else rows.select("product_id", "shade_id", F.lit(None).cast("int").alias("cluster_id"))
