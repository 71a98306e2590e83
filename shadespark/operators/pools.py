"""Candidate pools: shades of a catalogue around the colour anchors of a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color
from . import cells
from .relational import in_hue_band, neutral_guard

STEPS = (0.0, 2.0, 4.0, 8.0, 12.0)
CAP, POOL_MAX, COVERAGE_MIN = 30.0, 2000, 20
#: Queries that a task compares its shades with at most. More are cut into groups, which the shades meet by a shuffled join.
GROUP_QUERIES, SALTS = 10_000, 64
#: Pairs of shades and anchors up to which all are compared: a few seconds of one core, less than it takes to bound cells.
ALL_PAIRS = 20_000_000


def spread(shades: DataFrame) -> DataFrame:
    """shades over all shuffle partitions: a catalogue is small on disk, but every row of it is compared with all anchors."""
    return shades.repartition(int(shades.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def distances(shades: DataFrame, queries: DataFrame) -> DataFrame:
    """queries × shades with a colour, `de00` each.

    All pairs on purpose: the fall-backs of the pools rank whole catalogues. Callers pass distinct anchors
    (colour words, a bounded lexicon), filter or count at once, and never store the pairs.
    """
    s, n = shades.where("r is not null"), queries.count()
    if n <= GROUP_QUERIES:
        pairs = s.crossJoin(F.broadcast(queries))
    else:
        groups = -(-n // GROUP_QUERIES)
        q = queries.withColumns({"_group": F.pmod(F.xxhash64("query_id"), F.lit(groups)), "_salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
        s = s.withColumns({"_salt": F.pmod(F.xxhash64("product_id", "shade_id"), F.lit(SALTS)).cast("int"), "_group": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))})
        pairs = s.join(q, ["_group", "_salt"]).drop("_group", "_salt")
    return color.with_delta_e00(pairs, ("L_lab", "a_lab", "b_lab"), ("anchor_L", "anchor_a", "anchor_b"), "de00")


def _few(shades: DataFrame, queries: DataFrame) -> bool:
    return shades.count() * queries.count() <= ALL_PAIRS


def within_reach(shades: DataFrame, queries: DataFrame, limit: Column | None = None, k: int = 1) -> DataFrame:
    """As distances, without pairs of cells that are too far away: all pairs within limit (CAP) and the k nearest shades of each query are there. Of up to ALL_PAIRS pairs all are."""
    if _few(shades, queries):
        return distances(shades, queries)
    boxes, least = cells.boxes(shades), F.lit(CAP) if limit is None else limit
    if not k:
        return cells.near_distances(shades, queries, least, boxes)
    far = queries.join(cells.reach(boxes, queries, k), "query_id")
    return cells.near_distances(shades, far, F.greatest(least, F.col("_reach")), boxes).drop("_reach")


def base_threshold() -> Column:
    return F.when(F.col("anchor_C") < 18, 12.0).otherwise(18.0)


def hard_pool(pairs: DataFrame) -> DataFrame:
    """Pairs within the threshold; near a neutral anchor also within its guards. pairs: of `distances`."""
    return pairs.where((F.col("de00") <= base_threshold()) & neutral_guard())


def coverage(pairs: DataFrame) -> DataFrame:
    """query_id, min_de, n_within: smallest distance and count within the threshold."""
    return pairs.groupBy("query_id").agg(F.min("de00").alias("min_de"), F.count_if(F.col("de00") <= base_threshold()).alias("n_within"))


def coverage_sweep(pairs: DataFrame, thresholds: tuple[float, ...] = (18, 20, 22, 26, 30)) -> DataFrame:
    return pairs.groupBy("query_id").agg(*(F.count_if(F.col("de00") <= t).alias(f"n_{t:g}") for t in thresholds))


def effective_inventory(pairs: DataFrame, cov: DataFrame) -> DataFrame:
    """Pairs of the hue family (28 degrees in HSV hue, to nine digits, as many 8-bit colours lie on the edge) for queries of low coverage and low anchor chroma, if there are any; all pairs otherwise."""
    hue = color.hsv_hue(*(F.col(c) / 255 for c in "rgb"))
    flag = cov.select("query_id", (F.col("n_within") < COVERAGE_MIN).alias("_low"))
    marked = pairs.join(flag, "query_id").withColumn("_near", F.round(color.circ_dist(hue, F.col("anchor_hue")), 9) <= 28.0)
    some = F.max("_near").over(Window.partitionBy("query_id"))
    marked = marked.withColumn("_some", some)
    keep = ~(F.col("_low") & (F.col("anchor_C") < 55) & F.col("_some")) | F.col("_near")
    return marked.where(keep).drop("_low", "_near", "_some")


def adaptive_threshold(pairs: DataFrame, min_n: int, cap: float = CAP, base: Column | None = None) -> DataFrame:
    """query_id, thr, pool_n: the first widened threshold with min_n shades, else the widest that has any (thr null: none has)."""
    base = base_threshold() if base is None else base
    widths = [F.least(base + s, F.lit(cap)) for s in STEPS]
    counts = pairs.groupBy("query_id").agg(*(F.count_if(F.col("de00") <= w).alias(f"_n{k}") for k, w in enumerate(widths)), *(F.first(w).alias(f"_w{k}") for k, w in enumerate(widths)))
    enough = [F.when(F.col(f"_n{k}") >= min_n, F.struct(F.col(f"_w{k}").alias("thr"), F.col(f"_n{k}").alias("pool_n"))) for k in range(len(STEPS))]
    some = [F.when(F.col(f"_n{k}") > 0, F.struct(F.col(f"_w{k}").alias("thr"), F.col(f"_n{k}").alias("pool_n"))) for k in reversed(range(len(STEPS)))]
    return counts.select("query_id", F.coalesce(*enough, *some).alias("x")).select("query_id", "x.thr", "x.pool_n")


def adaptive_pool(pairs: DataFrame, min_n: int, cap: float = CAP) -> DataFrame:
    """Pairs within the adaptive threshold; where no step has any, the nearest max(min_n, 1)."""
    chosen = adaptive_threshold(pairs, min_n, cap)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("de00", "product_id", "shade_id"))
    j = pairs.join(chosen, "query_id")
    near = j.where("de00 <= thr")
    far = j.where("thr is null").withColumn("_n", rank).where(F.col("_n") <= max(min_n, 1)).drop("_n")
    return near.unionByName(far).drop("thr", "pool_n")


def capped(pool: DataFrame, top: int, order: list | None = None) -> DataFrame:
    """The nearest min(top, 2000) of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*(order or ["de00"]), "product_id", "shade_id"))
    return pool.withColumn("_n", rank).where(F.col("_n") <= min(top, POOL_MAX)).drop("_n")


def naming_pool(long: DataFrame, queries: DataFrame, least: float = 0.20, few: int = 20, top: int = 180) -> DataFrame:
    """Shades by their probability of the query's label: p >= least, or the best `top` where that leaves fewer than `few`."""
    j = long.join(queries.select("query_id", "label"), "label")
    over = Window.partitionBy("query_id")
    j = j.withColumns({"_many": F.count_if(F.col("p") >= least).over(over), "pool_rank": F.row_number().over(over.orderBy(F.desc_nulls_last("p"), "product_id", "shade_id"))})
    return j.where(F.when(F.col("_many") >= few, F.col("p") >= least).otherwise(F.col("pool_rank") <= top)).drop("_many")


def naming_gate(cov: DataFrame, sizes: DataFrame, labelled: DataFrame, few: int = 20) -> DataFrame:
    """query_id, gate: whether a query's shades come from naming probabilities: its label is supported, and it has fewer than `few` shades within its threshold, none there at all, or a pool of fewer than `few`.

    cov: of coverage, with anchor_C; sizes: query_id, size of the pool (none: 0); labelled: query_id of supported labels.
    """
    known = labelled.select("query_id", F.lit(True).alias("_known")).distinct()
    j = cov.join(sizes, "query_id", "left").join(known, "query_id", "left")
    poor = (F.col("n_within") < few) | (F.col("min_de") > base_threshold()) | (F.coalesce("size", F.lit(0)) < few)
    return j.select("query_id", (F.coalesce("_known", F.lit(False)) & F.coalesce(poor, F.lit(True))).alias("gate"))


def _anchor_hue() -> Column:
    return F.coalesce("anchor_hue", color.hue_deg(F.col("anchor_a"), F.col("anchor_b")))


def _hue_marks(hsv: Column) -> dict[str, Column]:
    """What the ladder of pools asks of hues: _near (28 degrees), _band and _wide, bands in HSV hue around that of the anchor's hex, or around its Lab hue where it has none."""
    return {"_near": in_hue_band(hsv, F.col("anchor_hue"), F.lit(28.0)), "_band": in_hue_band(hsv, _anchor_hue(), color.hue_band(F.col("anchor_C"))), "_wide": in_hue_band(hsv, _anchor_hue(), F.lit(32.0))}


def _shade_hue() -> Column:
    return color.hsv_hue(*(F.col(c) / 255 for c in "rgb"))


def _marks(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({**_hue_marks(_shade_hue()), "_guard": neutral_guard()})


def pool_plan(shades: DataFrame, queries: DataFrame, top: int = 1200) -> DataFrame:
    """The trace of the ladder of pools for each query: which pool it ends with, from one aggregation over the pairs that may be within reach and one over distinct hues.

    queries: query_id, anchor_*, constrained (whether the query has constraints). Hard pool on the effective
    inventory; widened for constrained queries under 120 (inside the hue band, or without it where the
    band is empty); widened again under 10; and in a wide hue band where that is still under 10.

    Returns query_id, min_de, n_within (coverage), family (whether the inventory is the hue family), source
    (hard, inv, band or wide), thr (NULL: the nearest n_nearest), n_nearest, size_hard, size, pool_method
    (the stages tried, joined by +).
    """
    top = min(top, POOL_MAX)
    widths = [F.least(base_threshold() + s, F.lit(CAP)) for s in STEPS]
    counts = {"min_de": F.min("de00"), "n_within": F.count_if(F.col("de00") <= base_threshold()), "anchor_C": F.first("anchor_C"), "constrained": F.first("constrained")}
    sources = (("inv", F.lit(True)), ("band", F.col("_band")), ("wide", F.col("_wide")))
    sizes = {"_some": F.max("_near")}
    for kind, among in (("all", F.lit(True)), ("near", F.col("_near"))):
        counts[f"hard_{kind}"] = F.count_if(among & F.col("_guard") & (F.col("de00") <= base_threshold()))
        for source, inside in sources:
            sizes[f"{source}_n_{kind}"] = F.coalesce(F.sum(F.when(among & inside, F.col("n"))), F.lit(0))
            for k, w in enumerate(widths):
                counts[f"{source}_{k}_{kind}"] = F.count_if(among & inside & (F.col("de00") <= w))
    named = lambda aggs: (c.alias(n) for n, c in aggs.items())
    hues = shades.where("r is not null").groupBy(_shade_hue().alias("_hue")).agg(F.count("*").alias("n"))
    asked = queries.select("query_id", "anchor_hue", "anchor_a", "anchor_b", "anchor_C")
    whole = hues.crossJoin(F.broadcast(asked) if asked.count() <= GROUP_QUERIES else asked).withColumns(_hue_marks(F.col("_hue"))).groupBy("query_id").agg(*named(sizes))
    got = _marks(within_reach(shades, queries)).groupBy("query_id").agg(*named(counts)).join(whole, "query_id")
    family = (F.col("n_within") < COVERAGE_MIN) & (F.col("anchor_C") < 55) & F.col("_some")
    got = got.withColumn("family", family)
    of = lambda name: F.when(F.col("family"), F.col(f"{name}_near")).otherwise(F.col(f"{name}_all"))

    def adaptive(source: str, min_n: int, before: Column, stage: str) -> Column:
        """The adaptive pool of a source as (source, thr, n_nearest, size, pool_method)."""
        whole, n = of(f"{source}_n"), [of(f"{source}_{k}") for k in range(len(STEPS))]
        found = F.coalesce(
            *(F.when(n[k] >= min_n, F.struct(widths[k].alias("thr"), n[k].alias("n"))) for k in range(len(STEPS))),
            *(F.when(n[k] > 0, F.struct(widths[k].alias("thr"), n[k].alias("n"))) for k in reversed(range(len(STEPS)))),
        )
        size = F.least(F.coalesce(found["n"], F.least(whole, F.lit(max(min_n, 1)))), F.lit(top))
        return _choice(source, found["thr"], F.lit(max(min_n, 1)), size, F.concat_ws("+", before["pool_method"], F.lit(stage)))

    got = got.withColumn("_0", _choice("hard", base_threshold(), F.lit(top), F.least(of("hard"), F.lit(top)), F.lit("hard")))
    at = F.col("_0")
    narrow = F.col("constrained") & (at["size"] < 120)
    step = F.when(narrow & (of("band_n") > 0), adaptive("band", 120, at, "band")).when(narrow & (of("inv_n") > 0), adaptive("inv", 120, at, "constraints")).otherwise(at)
    for k, (source, stage, wider) in enumerate((("", "", step), ("inv", "adaptive", None), ("wide", "wide", None)), 1):
        if source:
            wider = F.when((at["size"] < 10) & (of(f"{source}_n") > 0), adaptive(source, 10, at, stage)).otherwise(at)
        got = got.withColumn(f"_{k}", wider)
        at = F.col(f"_{k}")
    return got.select("query_id", "min_de", "n_within", "family", F.col("_0.size").alias("size_hard"), "_3.*")


def _choice(source: str, thr: Column, nearest: Column, size: Column, method: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), thr.cast("double").alias("thr"), nearest.cast("int").alias("n_nearest"), size.cast("long").alias("size"), method.alias("pool_method"))


def candidate_pool(shades: DataFrame, queries: DataFrame, plan: DataFrame, top: int = 1200) -> DataFrame:
    """The pools that plan (of pool_plan, stored) names, nearest shades first: columns of shades and queries, de00, pool_method."""
    top = min(top, POOL_MAX)
    chosen = queries.join(plan.select("query_id", "family", "source", "thr", "n_nearest", "pool_method"), "query_id")
    marked = _marks(distances(shades, chosen) if _few(shades, queries) else cells.near_distances(shades, chosen, F.col("thr")))
    inside = F.when(F.col("source") == "hard", F.col("_guard")).when(F.col("source") == "band", F.col("_band")).when(F.col("source") == "wide", F.col("_wide")).otherwise(True)
    some = marked.where((~F.col("family") | F.col("_near")) & inside & (F.col("thr").isNull() | (F.col("de00") <= F.col("thr"))))
    some = some.drop("_near", "_band", "_wide", "_guard", "family", "source")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("de00", "product_id", "shade_id"))
    return some.withColumn("_n", rank).where(f"_n <= {top}").where("thr is not null or _n <= n_nearest").drop("_n", "thr", "n_nearest")


def no_colour_pool(shades: DataFrame, top: int) -> DataFrame:
    """The first rows by id, for queries without a colour."""
    return shades.orderBy("product_id", "shade_id").limit(min(top, POOL_MAX))
