"""Constraints on scoring dimensions: parsing, thresholds, penalties and tilts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.color import SCORING_DIMS
from ..sources.calibration import LEVELS

# Fixed maps of the constraint adapter.
AXIS_DIM = {"brightness": "light_hsl", "saturation": "sat_hsl", "vibrancy": "sat_eff", "depth": "depth", "clarity": "colorfulness"}
LEVEL_OF = {("lower", "strong"): "low", ("lower", "med"): "medium", ("lower", "weak"): "high", ("raise", "strong"): "very_high", ("raise", "med"): "high", ("raise", "weak"): "medium"}
WEIGHT_OF = {"weak": 0.5, "med": 0.8, "strong": 1.0}


def lookup(table: dict, *keys: Column) -> Column:
    """A small fixed map as an expression; several keys are joined."""
    pairs = F.create_map(*(F.lit(x) for k, v in table.items() for x in ("|".join(k) if isinstance(k, tuple) else k, v)))
    return F.try_element_at(pairs, F.concat_ws("|", *keys))


def parse_constraints(df: DataFrame, blob: str = "constraints") -> DataFrame:
    """query_id, ord (from 1), dim, op, level, cutpoint, weight of "dim<=level|number:weight; ..." blobs; what does not parse has NULLs."""
    parts = F.posexplode(F.filter(F.split(F.col(blob), r"[;\n]"), lambda x: F.trim(x) != ""))
    form = r"^\s*([A-Za-z_]+)\s*(<=|>=)\s*([a-z_]+|[0-9]*\.?[0-9]+)\s*(?::\s*([0-9]*\.?[0-9]+))?\s*$"
    got = df.select("query_id", parts.alias("ord", "part")).where(~F.col("part").startswith("MIX:") & F.col("part").rlike("[<>]="))
    g = lambda k: F.nullif(F.regexp_extract("part", form, k), F.lit(""))
    number = g(3).try_cast("double")
    out = got.select("query_id", "part", "ord", g(1).alias("dim"), g(2).alias("op"), F.when(number.isNull(), g(3)).alias("level"), number.alias("cutpoint"), F.coalesce(g(4).try_cast("double"), F.lit(1.0)).alias("weight"))
    from pyspark.sql.window import Window

    return out.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).drop("part")


def parse_mix(df: DataFrame, blob: str = "constraints") -> DataFrame:
    """query_id, primary, secondary, alpha of the MIX: block, alpha held to 0..1."""
    g = lambda k, form: F.nullif(F.regexp_extract(F.col(blob), rf"MIX:[^<>]*\b{k}=({form})", 1), F.lit(""))
    return df.where(F.col(blob).startswith("MIX:")).select("query_id", g("primary", r"\d+").try_cast("int").alias("primary"), g("secondary", r"\d+").try_cast("int").alias("secondary"), stats.clip(g("alpha", r"[0-9.]+").try_cast("double"), 0, 1).alias("alpha"))


def mixed_anchors(mixes: DataFrame, prototypes: DataFrame) -> DataFrame:
    """query_id and the Lab mix of two prototypes."""
    p = prototypes.select(F.col("cluster_id").alias("primary"), *(F.col(c).alias(f"{c}_1") for c in ("L_lab", "a_lab", "b_lab")))
    s = prototypes.select(F.col("cluster_id").alias("secondary"), *(F.col(c).alias(f"{c}_2") for c in ("L_lab", "a_lab", "b_lab")))
    j = mixes.join(p, "primary").join(s, "secondary")
    return j.select("query_id", *((F.col("alpha") * F.col(f"{c}_1") + (1 - F.col("alpha")) * F.col(f"{c}_2")).alias(f"anchor_{c[0]}") for c in ("L_lab", "a_lab", "b_lab")))


def from_preferences(prefs: DataFrame) -> DataFrame:
    """Scoring constraints of (query_id, axis, direction, strength): op by direction, level by direction and strength, weaker weights unless strong."""
    dim = F.when(F.col("axis").isin(*SCORING_DIMS), F.col("axis")).otherwise(lookup(AXIS_DIM, F.col("axis")))
    weight = lookup(WEIGHT_OF, F.col("strength")) * F.when(F.col("strength") == "strong", 1.0).otherwise(0.5)
    return prefs.select("query_id", dim.alias("dim"), F.when(F.col("direction") == "raise", ">=").otherwise("<=").alias("op"), lookup(LEVEL_OF, F.col("direction"), F.col("strength")).alias("level"), weight.alias("weight"))


def thresholds(pool: DataFrame, constraints: DataFrame, calibration: DataFrame, shared: bool = False) -> DataFrame:
    """constraints with threshold and scale. Levels of relative dimensions are quantiles of the query's pool if that is large enough; all eight quantiles of a dimension come from one aggregation.

    Pools of queries (query_id) are capped, so that a group is small. With shared, pool is one catalogue of any
    size for all queries, and its exact quantiles are made once.
    """
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")).cast("int")
    c = constraints.join(calibration, "dim").withColumn("_k", level)
    relative = calibration.where("relative").select("dim", "quantiles").collect()  # one row for each scoring dimension
    aggs = [F.percentile(r["dim"], F.array(*(F.lit(min(0.999, max(0.001, x))) for q in r["quantiles"] for x in (q, 1 - q)))).alias(r["dim"]) for r in relative]
    counts = [F.count(r["dim"]).alias(f"_n_{r['dim']}") for r in relative]
    if shared:
        from .aggregates import exact_quantiles

        every = [(r["dim"], r["quantiles"]) for r in relative]
        values = pool.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("v")) for d, _ in every))).alias("x")).select("x.*")
        at = lambda q: min(0.999, max(0.001, q))
        grid = sorted({at(x) for _, qs in every for q in qs for x in (q, 1 - q)})
        got = exact_quantiles(values, ["dim"], "v", grid)
        pick = F.coalesce(*(F.when(F.col("dim") == d, F.array(*(F.col("q")[grid.index(at(x))] for q in qs for x in (q, 1 - q)))) for d, qs in every))
        j = c.join(got.select("dim", pick.alias("_q"), F.col("n").alias("_n")), "dim", "left")
        return _resolved(j, constraints.columns)
    wide = pool.groupBy("query_id").agg(*aggs, *counts)
    long = wide.select("query_id", F.explode(F.array(*(F.struct(F.lit(r["dim"]).alias("dim"), F.col(r["dim"]).alias("_q"), F.col(f"_n_{r['dim']}").alias("_n")) for r in relative))).alias("x")).select("query_id", "x.*")
    return _resolved(c.join(long, ["query_id", "dim"], "left"), constraints.columns)


def _resolved(j: DataFrame, columns: list[str]) -> DataFrame:
    own = F.when(F.col("relative") & (F.col("_n") >= F.col("min_pool_n")) & (F.col("_n") > 0), F.element_at("_q", F.col("_k") * 2 - F.when(F.col("op") == "<=", 0).otherwise(1)))
    fixed = F.when(F.col("_k") > 0, F.element_at("thresholds", F.col("_k")))
    return j.withColumn("threshold", F.coalesce("cutpoint", own, fixed)).select(*columns, "threshold", "scale")


def apply_constraints(pool: DataFrame, resolved: DataFrame, shared: bool = False) -> DataFrame:
    """pool with constraint_penalty_norm, constraint_tilt_norm and the breakdown array; a missing value counts as at the threshold.

    With shared, a whole catalogue is the pool of each of a bounded list of queries, whose constraints are broadcast.
    """
    suffix = F.when(F.col("cutpoint").isNull(), F.col("level")).otherwise(F.regexp_replace(F.format_string("%.6f", F.col("cutpoint")), r"\.?0+$", ""))
    packed = resolved.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ord", "dim", "op", suffix.alias("suffix"), "threshold", "scale", "weight"))).alias("_cs"))
    dims = F.create_map(*(x for d in SCORING_DIMS for x in (F.lit(d), F.col(d))))

    def one(c: Column) -> Column:
        v = F.coalesce(F.element_at("_dims", c["dim"]), c["threshold"])
        return F.struct(c["ord"].alias("ord"), c["dim"].alias("dim"), c["op"].alias("op"), c["suffix"].alias("suffix"), (c["weight"] * stats.hinge(v, c["op"], c["threshold"]) / c["scale"]).alias("penalty"), (c["weight"] * stats.tilt(v, c["op"], c["threshold"], c["scale"])).alias("tilt"), v.alias("value"))

    total = lambda field: F.aggregate("breakdown", F.lit(0.0), lambda s, x: s + x[field])
    out = pool.join(F.broadcast(packed) if shared else packed, "query_id", "left").withColumn("_dims", dims)
    out = out.withColumn("breakdown", F.coalesce(F.transform("_cs", one), F.array().cast("array<struct<ord:int,dim:string,op:string,suffix:string,penalty:double,tilt:double,value:double>>")))
    return out.withColumns({"constraint_penalty_norm": total("penalty"), "constraint_tilt_norm": total("tilt")}).drop("_cs", "_dims")


#: Rounds and smallest share of the pool of the joint feasibility of cut-points.
ROUNDS, SHARE = 12, 0.05


def snap_cutpoints(pool: DataFrame, constraints: DataFrame, calibration: DataFrame, share: float = SHARE, rounds: int = ROUNDS, clamp: bool = True, shared: bool = False) -> DataFrame:
    """constraints with numeric cut-points relaxed, one after the other and never tighter, until `share` of the query's pool satisfies all.

    A cut-point moves to the `share` quantile (from its open side) of the rows that satisfy the others, or of all
    rows where none does; with clamp no further than the loosest calibrated threshold of its dimension. Levels count
    with their fixed thresholds, missing values as satisfied. Queries drop out once they are feasible, or after a round that
    moved nothing; those without numeric cut-points, or without rows, pass by.

    A keyed fixpoint: a round is a chain of aggregations over the pool, one for each numeric constraint of a query, and a
    table of what is still active; the pool shrinks to distinct values with counts first, of which 8-bit colours allow
    2 ** 24. pool: query_id and the scoring dimensions, or with shared one catalogue for all queries. There, queries with
    equal constraints are relaxed once, and the quantiles of all rows are made once.
    """
    from ..sources.tables import grown, stored
    from .pools import spread

    if constraints.where("cutpoint is not null").isEmpty():
        return constraints
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")).cast("int")
    c = constraints.join(calibration, "dim").withColumns({"_k": level, "_at": F.array_position(F.array(*map(F.lit, SCORING_DIMS)), F.col("dim")).cast("int")})
    one = F.struct("ord", F.col("_at").alias("at"), (F.col("op") == "<=").alias("cap"), F.col("cutpoint").isNotNull().alias("numeric"), F.coalesce("cutpoint", F.when(F.col("_k") > 0, F.element_at("thresholds", F.col("_k")))).alias("thr"), F.array_min("thresholds").alias("lo"), F.array_max("thresholds").alias("hi"))
    active = c.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("cs")).where(F.exists("cs", lambda x: x["numeric"]))
    if shared:
        asked = stored(active.withColumn("_key", F.to_json("cs")), "snap-asked")
        active = asked.groupBy("_key").agg(F.min("query_id").alias("query_id"), F.min_by("cs", "query_id").alias("cs"))
    active = stored(active.withColumn("moved", F.lit(True)), "snap")
    most = active.agg(F.max(F.size(F.filter("cs", lambda x: x["numeric"]))).alias("n")).first()["n"] or 0
    keys = [] if shared else ["query_id"]
    rows = pool if shared else pool.join(active.select("query_id"), "query_id", "left_semi")
    rows = rows.groupBy(*keys, *SCORING_DIMS).agg(F.count("*").alias("n")).select(*keys, F.array(*(F.col(d).cast("double") for d in SCORING_DIMS)).alias("v"), "n")
    rows = stored(spread(rows) if shared else rows, "snap-rows")
    at = F.array(F.lit(share), F.lit(1 - share))
    if shared:
        value = lambda k: F.when(~F.isnan(F.element_at("v", k)), F.element_at("v", k))
        whole = rows.agg(*(F.percentile(value(k + 1), at, F.col("n")).alias(d) for k, d in enumerate(SCORING_DIMS))).first()  # two numbers for each dimension
        whole = F.array(*(F.lit(whole[d]).cast("array<double>") if whole[d] is None else F.array(*map(F.lit, whole[d])) for d in SCORING_DIMS))

    def holds(v: Column, x: Column) -> Column:
        at = F.element_at(v, x["at"])
        return at.isNull() | F.isnan(at) | F.when(x["cap"], at <= x["thr"]).otherwise(at >= x["thr"])

    def met(state: DataFrame) -> DataFrame:
        """Rows with the state of each of their queries."""
        if not shared:
            return rows.join(state, "query_id")
        return rows.crossJoin(F.broadcast(state)) if few else rows.crossJoin(state)

    few = active.count() <= 10_000  # states of one broadcast
    named = active.select("query_id", "_key") if shared else None
    done = []
    for _ in range(rounds):
        state = active.select("query_id", "cs", F.lit(False).alias("moved"), F.lit(False).alias("enough"))
        for k in range(most):
            each = met(state).withColumn("x", F.get(F.filter("cs", lambda c: c["numeric"]), F.lit(k))).withColumn("y", F.element_at("v", F.col("x.at")))
            others = F.forall("cs", lambda c: (c["ord"] == F.col("x.ord")) | holds(F.col("v"), c))
            each = each.withColumns({"y": F.when(~F.isnan("y"), F.col("y")), "others": others, "all": F.when(F.forall("cs", lambda c: holds(F.col("v"), c)), F.col("n")).otherwise(0)})
            keep = ("cs", "x", "moved", "enough")
            got = each.groupBy("query_id").agg(
                F.any_value(F.struct(*keep)).alias("kept"), (F.sum("all") / F.sum("n") >= share).alias("feasible"), F.max("others").alias("some"),
                F.percentile(F.when(F.col("others"), F.col("y")), at, F.col("n")).alias("of_others"), *(() if shared else (F.percentile("y", at, F.col("n")).alias("of_all"),)),
            )
            got = got.select("query_id", "kept.*", "feasible", "some", "of_others", F.element_at(whole, F.col("kept.x.at")).alias("of_all") if shared else "of_all")
            got = got.withColumn("enough", F.col("feasible") if k == 0 else F.col("enough"))
            q = F.when(F.col("some"), F.col("of_others")).otherwise(F.col("of_all"))
            new = F.when(F.col("x.cap"), F.greatest("x.thr", q[0])).otherwise(F.least("x.thr", q[1]))
            if clamp:
                new = F.when(F.col("x.cap"), F.least(new, F.col("x.hi"))).otherwise(F.greatest(new, F.col("x.lo")))
            moves = F.coalesce(~F.col("enough") & F.col("x").isNotNull() & q[0].isNotNull() & (F.abs(new - F.col("x.thr")) > 1e-12), F.lit(False))
            got = got.withColumns({"new": new, "moves": moves})
            cs = F.when(F.col("moves"), F.transform("cs", lambda c: F.when(c["ord"] == F.col("x.ord"), c.withField("thr", F.col("new"))).otherwise(c))).otherwise(F.col("cs"))
            state = got.select("query_id", cs.alias("cs"), (F.col("moved") | F.col("moves")).alias("moved"), "enough")
        state = stored(state, "snap")
        done.append(state.where("enough or not moved").select("query_id", "cs"))
        active = state.where("not enough and moved")
        if active.isEmpty():
            break
    else:
        done.append(active.select("query_id", "cs"))
    snapped = done[0]
    for d in done[1:]:
        snapped = snapped.unionByName(d)
    thr = snapped.select("query_id", F.explode(F.filter("cs", lambda x: x["numeric"])).alias("x")).select("query_id", F.col("x.ord").alias("ord"), F.col("x.thr").alias("_new"))
    if shared:
        sets = named.join(thr, "query_id").drop("query_id")
        thr = asked.select("query_id", "_key").join(F.broadcast(sets) if few else grown(sets), "_key").drop("_key")
    return constraints.join(grown(thr), ["query_id", "ord"], "left").withColumn("cutpoint", F.coalesce("_new", "cutpoint")).select(*constraints.columns)
