"""Pools, scores, families, texts, assets and learning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import udf
from ..operators import aggregates, cells, constraints, pools, preference, relational, scoring
from ..plans import assets, learning, recommend
from ..sources import calibration, fixtures, tables
from ..streaming import jobs
from ..sources.calibration import DELTA_E_REF, LABEL_DISTRIBUTIONS, LEVELS, RELATIVE, SCALE_IQR, THRESHOLDS
from .base import ANCHORS, PAIRS, PROBS, SHADES, query, rounded, with_
from .catalogue import BAD
from .wishes import WISH as _WISH
from .wishes import constraint_parts, texts, tokens

# Fixed constraint strings by cluster.
BLOBS = ("C_lab<=very_high:1.5", "C_lab<=high:1.5;sat_eff<=high:0.8", "C_lab>=high:1.0;sat_eff>=high:0.8", "depth>=high:0.8;C_lab<=very_high:1.2", "L_lab>=medium:0.6;L_lab<=high:0.8", "warmth>=high:0.8;C_lab<=high:0.8", "light_hsl<=low:1;sat_hsl>=very_high:0.5", "MIX:primary=2;secondary=3;alpha=0.7;C_lab<=very_high:1.2")
_PARSED = [(k, n + 1, part) for k, blob in enumerate(BLOBS) for n, part in enumerate(p for p in blob.split(";") if "=" in p and ("<=" in p or ">=" in p))]


def _rows():
    for k, n, part in _PARSED:
        op = "<=" if "<=" in part else ">="
        dim, rest = part.split(op)
        level, weight = rest.split(":")
        yield k, n, dim, op, level, float(weight)


_CONS = "cons as (select * from (values " + ", ".join(f"({k}, {n}, '{d}', '{o}', '{lv}', cast({w!r} as double))" for k, n, d, o, lv, w in _rows()) + ") v(query_id, ord, dim, op, level, weight))"
_DIM = "case dim " + " ".join(f"when '{d}' then {d}" for d in THRESHOLDS) + " end"
_FIX = "case dim || level " + " ".join(f"when '{d}{lv}' then {t!r}" for d, ts in THRESHOLDS.items() for lv, t in zip(LEVELS, ts)) + " end"
_SCALE = "case dim " + " ".join(f"when '{d}' then {s!r}::double" for d, s in SCALE_IQR.items()) + " end"
_REL = "case dim || op || level " + " ".join(f"when '{d}{op}{lv}' then quantile_cont(v, {(q if op == '>=' else 1 - q)!r})" for d, (_, qs) in RELATIVE.items() for op in ("<=", ">=") for lv, q in zip(LEVELS, qs)) + " end"
_PROTO = "proto as (select cluster_id as query_id, avg(L_lab) as l0, avg(a_lab) as a0, avg(b_lab) as b0 from shades where r is not null group by cluster_id)"
_SCORED = (
    f"val as (select c.*, s.shade_id, {_DIM} as v from cons c cross join shades s where r is not null)",
    f"thr as (select query_id, ord, any_value(dim) as dim, coalesce(case when count(v) >= 120 then {_REL.replace('dim ||', 'any_value(dim) ||').replace('|| op ||', '|| any_value(op) ||').replace('|| level', '|| any_value(level)')} end, {_FIX.replace('dim || level', 'any_value(dim) || any_value(level)')}) as thr, {_SCALE.replace('case dim', 'case any_value(dim)')} as scale from val group by query_id, ord)",
    "pen as (select query_id, shade_id, sum(weight*greatest(0, case when op = '<=' then v - thr else thr - v end)/scale) as pen, sum(weight*tanh(case when op = '>=' then v/scale - thr/scale else thr/scale - v/scale end)) as tilt from val join thr using (query_id, ord) group by all)",
    f"sc as (select s.*, p.query_id, sqrt(power(L_lab-l0,2)+power(a_lab-a0,2)+power(b_lab-b0,2))/{DELTA_E_REF!r} as den, pen, tilt from shades s cross join proto p join pen on pen.query_id = p.query_id and pen.shade_id = s.shade_id where r is not null)",
    "fin as (select *, -den - 4*pen + 2.4*tilt as score from sc)",
    "ded as (select *, row_number() over (partition by query_id, url, shade_name order by round(score, 9) desc, product_id, shade_id) as k from fin)",
    "rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, product_id, shade_id) as rank from ded where k = 1)",
)


def _blobs(spark):
    return spark.createDataFrame(list(enumerate(BLOBS)), "query_id int, constraints string")


def _prototypes(df):
    return df.where("r is not null").groupBy(F.col("cluster_id").alias("query_id")).agg(*(F.avg(f"{c}_lab").alias(f"anchor_{c}") for c in ("L", "a", "b")))


@query(
    "with p as (select p_partkey as query_id, ([" + ", ".join(f"'{b}'" for b in BLOBS) + f"])[p_partkey % {len(BLOBS)} + 1] || ';' || chr(10) || 'warmth>=0.' || (p_partkey % 90 + 10) || ':' || (p_partkey % 5) || '; nonsense<=' as b from part), "
    "t as (select query_id, unnest(x) as t, generate_subscripts(x, 1) as k from (select query_id, list_filter(regexp_split_to_array(b, '[;\n]'), lambda y: trim(y) <> '' and not starts_with(y, 'MIX:') and regexp_matches(y, '[<>]=')) as x from p)), "
    r"m as (select query_id, k, regexp_extract(trim(t), '^([A-Za-z_]+)(<=|>=)([a-z_]+|[0-9]*\.?[0-9]+):?([0-9.]*)$', ['dim', 'op', 'v', 'w']) as m from t) ".replace("\\\\", "\\")
    + "select query_id, k as ord, nullif(m.dim, '') as dim, nullif(m.op, '') as op, case when try_cast(m.v as double) is null then nullif(m.v, '') end as level, try_cast(nullif(m.v, '') as double) as cutpoint, coalesce(try_cast(nullif(m.w, '') as double), 1.0) as weight from m"
)
def sco1_parse(spark, sf_dir):
    """A constraint string for each part: the fixed forms, with a weight of its own."""
    k = F.col("p_partkey")
    blob = F.element_at(F.array(*map(F.lit, BLOBS)), (k % len(BLOBS) + 1).cast("int"))
    rows = fixtures.table(spark, sf_dir, "part").select(k.alias("query_id"), F.concat(blob, F.lit(";\nwarmth>=0."), (k % 90 + 10).cast("string"), F.lit(":"), (k % 5).cast("string"), F.lit("; nonsense<=")).alias("constraints"))
    return constraints.parse_constraints(rows).select("query_id", "ord", "dim", "op", "level", "cutpoint", "weight")


@query(with_(SHADES, _CONS, *_SCORED[:2], select="select query_id, ord, dim, round(thr, 6) as threshold, round(scale, 6) as scale from thr"))
def sco4_thresholds(spark, sf_dir):
    pool = tables.stored(fixtures.shades(spark, sf_dir).where("r is not null"), "shades")
    got = constraints.thresholds(pool, constraints.parse_constraints(_blobs(spark)), calibration.calibration(spark), shared=True)
    return got.select("query_id", "ord", "dim", *rounded("threshold", "scale"))


def _snap_sql() -> tuple[str, ...]:
    """SQL of the relaxed cut-points t1 and t2 of the constraints in sn: twelve rounds, one constraint after the other."""
    bound = {d: (min(THRESHOLDS[d]), max(THRESHOLDS[d])) for d in ("light_hsl", "sat_hsl")}
    one, two = "(light_hsl is null or light_hsl <= t1)", "(sat_hsl is null or sat_hsl >= t2)"
    third = f"case when lv then depth is null or depth >= {THRESHOLDS['depth'][2]!r} else warmth is null or warmth <= {THRESHOLDS['warmth'][0]!r} end"
    parts = ["sv as materialized (select light_hsl, sat_hsl, depth, warmth from shades where r is not null)", "s0 as materialized (select query_id, lv, t1, t2, true as active from sn)"]
    moved = lambda q, others: f"coalesce(quantile_cont({q[0]}, {q[1]}) filter ({others}), quantile_cont({q[0]}, {q[1]}))"
    for k in range(constraints.ROUNDS):
        parts += [
            f"e{k} as materialized (select query_id, any_value(lv) as lv, any_value(t1) as t1, any_value(t2) as t2, any_value(active) and avg(case when {one} and {two} and {third} then 1.0 else 0.0 end) < {constraints.SHARE} as open, {moved(('light_hsl', constraints.SHARE), f'{two} and {third}')} as n1 from s{k}, sv group by query_id)",
            f"f{k} as materialized (select query_id, lv, t1 as o1, t2, open, case when open then least(greatest(t1, n1), {bound['light_hsl'][1]!r}) else t1 end as t1 from e{k})",
            f"g{k} as materialized (select query_id, any_value(lv) as lv, any_value(o1) as o1, any_value(t1) as t1, any_value(t2) as t2, any_value(open) as open, {moved(('sat_hsl', 1 - constraints.SHARE), f'{one} and {third}')} as n2 from f{k}, sv group by query_id)",
            f"s{k + 1} as materialized (select query_id, lv, t1, u as t2, open and (abs(t1 - o1) > 1e-12 or abs(u - t2) > 1e-12) as active from (select *, case when open then greatest(least(t2, n2), {bound['sat_hsl'][0]!r}) else t2 end as u from g{k}))",
        ]
    return tuple(parts)


@query(
    with_(
        SHADES, "sn as (select s_suppkey as query_id, s_suppkey % 2 = 0 as lv, (s_suppkey % 40 + 5) / 100e0 as t1, (50 + s_suppkey % 45) / 100e0 as t2 from supplier)", *_snap_sql(),
        select=f"select query_id, ord, dim, op, level, round(case ord when 1 then t1 when 2 then t2 end, 6) as cutpoint, weight from s{constraints.ROUNDS}, (values (1, 'light_hsl', '<=', 1.0::double), (2, 'sat_hsl', '>=', 1.0::double), (3, null, null, 0.5::double)) v(ord, dim0, op0, weight), lateral (select coalesce(dim0, case when lv then 'depth' else 'warmth' end) as dim, coalesce(op0, case when lv then '>=' else '<=' end) as op, case when ord = 3 then case when lv then 'high' else 'low' end end as level)",
    )
)
def sco8_snap(spark, sf_dir):
    """Two cut-points and a level for each supplier, against the whole catalogue."""
    k = F.col("s_suppkey")
    number = lambda base, mod: F.format_string("0.%02d", (base + k % mod).cast("int"))
    blob = F.concat(F.lit("light_hsl<="), number(5, 40), F.lit(":1;sat_hsl>="), number(50, 45), F.when(k % 2 == 0, ":1;depth>=high:0.5").otherwise(":1;warmth<=low:0.5"))
    cons = constraints.parse_constraints(fixtures.table(spark, sf_dir, "supplier").select(k.alias("query_id"), blob.alias("constraints")))
    catalogue = tables.stored(fixtures.shades(spark, sf_dir).where("r is not null"), "shades")
    got = constraints.snap_cutpoints(catalogue, cons, calibration.calibration(spark), shared=True)
    return got.select("query_id", "ord", "dim", "op", "level", F.round("cutpoint", 6).alias("cutpoint"), "weight")


@query(with_(SHADES, _CONS, _PROTO, *_SCORED, select="select query_id, rank, shade_id, round(score, 6) as score, round(pen, 6) as penalty, round(tilt, 6) as tilt from rk where rank <= 20"))
def sco11_score(spark, sf_dir):
    df = tables.stored(fixtures.shades(spark, sf_dir), "shades")
    got = recommend.score_inventory(df, _prototypes(df), _blobs(spark), calibration.calibration(spark), k=20)
    return got.select("query_id", "rank", "shade_id", F.round("score", 6).alias("score"), F.round("constraint_penalty_norm", 6).alias("penalty"), F.round("constraint_tilt_norm", 6).alias("tilt"))


@query(with_(SHADES, _PROTO, select="select 7 as query_id, round(0.7*a.l0 + 0.3*b.l0, 6) as anchor_L, round(0.7*a.a0 + 0.3*b.a0, 6) as anchor_a, round(0.7*a.b0 + 0.3*b.b0, 6) as anchor_b from proto a, proto b where a.query_id = 2 and b.query_id = 3"))
def sco2_mix(spark, sf_dir):
    p = _prototypes(fixtures.shades(spark, sf_dir)).toDF("cluster_id", "L_lab", "a_lab", "b_lab")
    return constraints.mixed_anchors(constraints.parse_mix(_blobs(spark)), p).select("query_id", *rounded("anchor_L", "anchor_a", "anchor_b"))


def _pairs(spark, sf_dir):
    """Eligible shades against the anchors, with the columns that pools need; computed where they are used."""
    df = relational.with_colour(relational.eligible(fixtures.shades(spark, sf_dir)))
    df = df.select("product_id", "shade_id", "r", "g", "b", "L_lab", "a_lab", "b_lab", "C_lab", "H_lab_deg")
    return pools.distances(tables.stored(pools.spread(df), "catalogue"), fixtures.anchors(spark))


def _within(spark, sf_dir, limit=None, k=1):
    """As _pairs, of cells within reach alone."""
    df = relational.with_colour(relational.eligible(fixtures.shades(spark, sf_dir)))
    df = df.select("product_id", "shade_id", "r", "g", "b", "L_lab", "a_lab", "b_lab", "C_lab", "H_lab_deg")
    return pools.within_reach(tables.stored(pools.spread(df), "catalogue"), fixtures.anchors(spark), limit, k)


_ELIGIBLE = PAIRS.replace("where r is not null)", f"where r is not null and not {BAD})", 1)
_GUARD = "(anchor_C >= 18 or (L_lab < 98.5 and sqrt(a_lab*a_lab+b_lab*b_lab) > 3 and abs(L_lab-anchor_L) <= 22 and abs(a_lab-anchor_a) <= 10 and abs(b_lab-anchor_b) <= 14))"


@query(with_(SHADES, ANCHORS, _ELIGIBLE, select=f"select query_id, shade_id, round(de00, 5) as de00 from pairs where de00 <= base and {_GUARD}"))
def pol1_hard_pool(spark, sf_dir):
    return pools.hard_pool(_within(spark, sf_dir, pools.base_threshold(), k=0)).select("query_id", "shade_id", F.round("de00", 5).alias("de00"))


@query(with_(SHADES, ANCHORS, _ELIGIBLE, select="select query_id, round(min(de00), 5) as min_de, count(*) filter (de00 <= base) as n_within, count(*) filter (de00 <= 18) as n_18, count(*) filter (de00 <= 20) as n_20, count(*) filter (de00 <= 22) as n_22, count(*) filter (de00 <= 26) as n_26, count(*) filter (de00 <= 30) as n_30 from pairs group by query_id"))
def pol2_coverage(spark, sf_dir):
    p = _within(spark, sf_dir)
    return pools.coverage(p).join(pools.coverage_sweep(p), "query_id").withColumn("min_de", F.round("min_de", 5))


@query(with_(SHADES, ANCHORS, _ELIGIBLE, select="select query_id, n as t, count(*) filter (de00 <= n) as within from pairs, (values (12), (18), (30)) v(n) group by all"))
def jon9_near(spark, sf_dir):
    """Shades within three distances of each anchor, from cells that may hold one."""
    q = fixtures.anchors(spark).crossJoin(spark.createDataFrame([(12,), (18,), (30,)], "t int"))
    df = relational.with_colour(relational.eligible(fixtures.shades(spark, sf_dir))).select("r", "L_lab", "a_lab", "b_lab")
    got = cells.near_distances(tables.stored(pools.spread(df), "catalogue"), q, F.col("t"))
    got = got.groupBy("query_id", "t").agg(F.count_if(F.col("de00") <= F.col("t")).alias("within"))
    return q.select("query_id", "t").join(got, ["query_id", "t"], "left").withColumn("within", F.coalesce("within", F.lit(0)))


@query(
    with_(
        SHADES, ANCHORS, _ELIGIBLE,
        "n as (select query_id, any_value(base) as base, count(*) filter (de00 <= base) as n0, count(*) filter (de00 <= least(base+2, 30)) as n2, count(*) filter (de00 <= least(base+4, 30)) as n4, count(*) filter (de00 <= least(base+8, 30)) as n8, count(*) filter (de00 <= least(base+12, 30)) as n12 from pairs group by query_id)",
        "t as (select query_id, case when n0 >= 120 then base when n2 >= 120 then least(base+2,30) when n4 >= 120 then least(base+4,30) when n8 >= 120 then least(base+8,30) when n12 > 0 then least(base+12,30) end as thr from n)",
        select="select query_id, count(*) as n, round(max(de00), 5) as widest from (select *, row_number() over (partition by query_id order by de00, product_id, shade_id) as k from pairs join t using (query_id)) where de00 <= thr or (thr is null and k <= 120) group by query_id",
    )
)
def pol5_adaptive(spark, sf_dir):
    return pools.adaptive_pool(_within(spark, sf_dir, k=120), 120).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("de00"), 5).alias("widest"))


@query(
    with_(
        SHADES, ANCHORS, _ELIGIBLE,
        "e as (select *, round(abs((((hue_hsv_deg - anchor_hue + 180) % 360 + 360) % 360) - 180), 9) <= 28 as near, count(*) filter (de00 <= base) over (partition by query_id) as n_within from pairs)",
        select="select query_id, count(*) as n from (select *, bool_or(near) over (partition by query_id) as has from e) where not (n_within < 20 and anchor_C < 55 and has) or near group by query_id",
    )
)
def pol3_hue_family(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return pools.effective_inventory(p, pools.coverage(p)).groupBy("query_id").agg(F.count("*").alias("n"))


@query(
    with_(
        SHADES, PROBS,
        "n as (select *, count(*) filter (p >= 0.2) over (partition by label) as many, row_number() over (partition by label order by p desc, product_id, shade_id) as k from probs)",
        select="select label as query_id, shade_id, round(p, 6) as p from n where case when many >= 20 then p >= 0.2 else k <= 180 end",
    )
)
def pol8_naming_pool(spark, sf_dir):
    q = spark.createDataFrame([(n, n) for n in fixtures.LABELS], "query_id string, label string")
    long = tables.stored(fixtures.naming_long(fixtures.shades(spark, sf_dir)), "naming")
    return pools.naming_pool(long, q).select("query_id", "shade_id", F.round("p", 6).alias("p"))


def _wishes(spark, sf_dir):
    queries, cons = recommend.wishes(texts(spark, sf_dir), fixtures.anchors(spark))
    return tables.stored(queries, "queries"), tables.stored(cons, "constraints")


def _wish_pools() -> tuple[str, ...]:
    """SQL of the pools of every (anchor, constrained): counts, the ladder's choice, and the rows."""
    widths = [f"least(base + {w}, 30)" for w in (0, 2, 4, 8, 12)]
    inside = {"inv": "true", "band": "band", "wide": "wide"}
    counts = ", ".join([f"count(*) filter (guard and de00 <= base) as hard", *(f"count(*) filter ({x}) as {s}_n" for s, x in inside.items()), *(f"count(*) filter ({x} and de00 <= {w}) as {s}_{k}" for s, x in inside.items() for k, w in enumerate(widths))])

    def of(source, least, what):
        value = (lambda k: widths[k]) if what == "thr" else (lambda k: f"{source}_{k}")
        cases = [f"when {source}_{k} >= {least} then {value(k)}" for k in range(5)] + [f"when {source}_{k} > 0 then {value(k)}" for k in (4, 3, 2, 1, 0)]
        return f"(case {' '.join(cases)} else {'null' if what == 'thr' else f'least({source}_n, {least})'} end)"

    def step(k, rules):
        """The choice k from the choice k - 1: rules are (condition, source, least size, stage)."""
        pick = lambda make, old: "case " + " ".join(f"when {c} then {make(*r)}" for c, *r in rules) + f" else {old} end"
        return (
            f"l{k} as (select * exclude (src, thr, near_n, size, method), {pick(lambda s, n, m: repr(s), 'src')} as src, {pick(lambda s, n, m: of(s, n, 'thr'), 'thr')} as thr, {pick(lambda s, n, m: str(n), 'near_n')} as near_n, "
            f"{pick(lambda s, n, m: 'least(' + of(s, n, 'n') + ', 1200)', 'size')} as size, {pick(lambda s, n, m: f'method || {chr(39)}+{m}{chr(39)}', 'method')} as method from l{k - 1})"
        )

    return (
        "mk as (select *, abs((((hue_hsv_deg - anchor_hue + 180) % 360 + 360) % 360) - 180) <= 28 as near, abs((((hue_hsv_deg - anchor_hue + 180) % 360 + 360) % 360) - 180) as hd from pairs)",
        f"mq as (select *, hd <= least(greatest(anchor_C*0.2 + 18, 18), 36) as band, hd <= 32 as wide, {_GUARD} as guard, count(*) filter (de00 <= base) over w < 20 and anchor_C < 55 and bool_or(near) over w as fam from mk window w as (partition by query_id))",
        "iv as (select * from mq where not fam or near)",
        f"pc as (select query_id, any_value(base) as base, {counts} from iv group by query_id)",
        "l0 as (select *, 'hard' as src, cast(base as double) as thr, 1200 as near_n, least(hard, 1200) as size, 'hard' as method from pc, (values (false), (true)) v(con))",
        step(1, [("con and size < 120 and band_n > 0", "band", 120, "band"), ("con and size < 120 and inv_n > 0", "inv", 120, "constraints")]),
        step(2, [("size < 10 and inv_n > 0", "inv", 10, "adaptive")]),
        step(3, [("size < 10 and wide_n > 0", "wide", 10, "wide")]),
        "pw as (select iv.*, con, method, row_number() over (partition by query_id, con order by round(de00, 9), product_id, shade_id) as pk, thr, near_n from iv join l3 using (query_id) where (thr is null or de00 <= thr) and case src when 'hard' then guard when 'band' then band when 'wide' then wide else true end)",
        "po as (select * from pw where pk <= 1200 and (thr is not null or pk <= near_n))",
    )


_WISHED = (
    SHADES, ANCHORS, _ELIGIBLE, _WISH, tokens("(select text_id, text as t from w)", "text_id"), *constraint_parts("text_id"),
    "nm as (select text_id, arg_min(word, i) as name from tok join anchors on query_id = word group by text_id)",
    "ax as (select text_id, any_value(axis) as axis from co group by text_id)",  # a wish has one axis word at most, and lowers it strongly
    "qs as (select text_id, name, case axis when 'brightness' then 'light_hsl' when 'vibrancy' then 'sat_eff' end as dim from nm left join ax using (text_id))",
    *_wish_pools(),
    "ws as (select po.*, q.dim from po join (select distinct name, dim from qs) q on q.name = po.query_id and (q.dim is not null) = po.con)",
    f"""tv as (select query_id, dim, case dim when 'light_hsl' then case when count(*) >= {RELATIVE['light_hsl'][0]} then quantile_cont(light_hsl, {1 - RELATIVE['light_hsl'][1][0]!r}) else {THRESHOLDS['light_hsl'][0]!r} end when 'sat_eff' then {THRESHOLDS['sat_eff'][0]!r} end as thr,
  case dim when 'light_hsl' then {SCALE_IQR['light_hsl']!r}::double when 'sat_eff' then {SCALE_IQR['sat_eff']!r}::double end as scale from ws group by query_id, dim)""",
    f"""wv as (select ws.*, sqrt(power(L_lab-anchor_L,2)+power(a_lab-anchor_a,2)+power(b_lab-anchor_b,2))/{DELTA_E_REF!r} as den, tv.thr as t, scale, case ws.dim when 'light_hsl' then light_hsl when 'sat_eff' then sat_eff end as v
  from ws join tv on tv.query_id = ws.query_id and tv.dim is not distinct from ws.dim)""",
    "sc as (select *, -den - 8*coalesce(greatest(0, v - t)/scale, 0) + 4.8*coalesce(tanh(t/scale - v/scale), 0) as score from wv)",
    "d1 as (select *, row_number() over (partition by query_id, dim, url, shade_name order by round(score, 9) desc, product_id, shade_id) as k1 from sc)",
    "d2 as (select *, score - den * case when dim is not null and anchor_C < 25 then 2.25 when dim is not null then 1.5 else 0.75 end as total from d1 where k1 = 1)",
    "d3 as (select *, row_number() over (partition by query_id, dim order by round(total, 9) desc, product_id, shade_id) as rank from d2)",
)


@query(with_(*_WISHED, select="select qs.text_id as query_id, rank, product_id, shade_id, round(total, 6) as score_total, method as pool_method from d3 join qs on qs.name = d3.query_id and qs.dim is not distinct from d3.dim where rank <= 20"))
def sco14_recommend(spark, sf_dir):
    queries, cons = _wishes(spark, sf_dir)
    got = recommend.recommend(fixtures.shades(spark, sf_dir), queries, cons, calibration.calibration(spark))
    return got.select("query_id", "rank", "product_id", "shade_id", F.round("score_total", 6).alias("score_total"), "pool_method")


@query(with_(*_WISHED, select="select qs.text_id as query_id, rank, product_id, shade_id, round(total, 6) as score_total, method as pool_method from d3 join qs on qs.name = d3.query_id and qs.dim is not distinct from d3.dim where rank <= 20"))
def str2_recommend(spark, sf_dir):
    """The texts of sco14_recommend arrive in three files, one to a micro-batch."""
    source, sink = tables.scratch(spark, "asked"), tables.scratch(spark, "answered")
    texts(spark, sf_dir).withColumn("part", F.col("text_id") % 3).repartition(3, "part").drop("part").write.parquet(source)
    job = jobs.Recommender(fixtures.shades(spark, sf_dir), fixtures.anchors(spark), calibration.calibration(spark), tables.scratch(spark, "pools"), sink)
    job.start(spark.readStream.schema("text_id long, text string").option("maxFilesPerTrigger", 1).parquet(source), tables.scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(sink).select("query_id", "rank", "product_id", "shade_id", F.round("score_total", 6).alias("score_total"), "pool_method")


@query(with_(*_WISHED, select="""select qs.text_id as query_id, rank, product_id, shade_id, 'Hue Δ' || cast(round(abs((((hue_hsv_deg - anchor_hue + 180) % 360 + 360) % 360) - 180)) as int) || '° | ΔE ' || printf('%.2f', round(den, 2)) || case when d3.dim is not null and coalesce(greatest(0, v - t)/scale, 0) <= 0.05 then ' | Good constraint fit' else '' end as reasons
  from d3 join qs on qs.name = d3.query_id and qs.dim is not distinct from d3.dim where rank <= 20"""))
def fun23_reasons(spark, sf_dir):
    queries, cons = _wishes(spark, sf_dir)
    got = recommend.explain(fixtures.shades(spark, sf_dir), queries, cons, calibration.calibration(spark))
    return got.select("query_id", "rank", "product_id", "shade_id", F.array_join("reasons", " | ").alias("reasons"))


@query(with_(*_WISHED, "cv as (select query_id, round(min(de00), 5) as min_de, count(*) filter (de00 <= base) as n_within from pairs group by query_id)",
    select="select qs.text_id as query_id, min_de, n_within, least(l3.hard, 1200) as size_hard, l3.size as pool_size, round(l3.thr, 5) as thr, method as pool_method from qs join l3 on l3.query_id = qs.name and l3.con = (qs.dim is not null) join cv on cv.query_id = qs.name"))
def sco15_explain(spark, sf_dir):
    queries, cons = _wishes(spark, sf_dir)
    got = recommend.explain(fixtures.shades(spark, sf_dir), queries, cons, calibration.calibration(spark), k=1)
    return got.select("query_id", F.round("min_de", 5).alias("min_de"), "n_within", "size_hard", "pool_size", F.round("thr", 5).alias("thr"), "pool_method")


_INTENT = "i as (select c_custkey // 4 as text_id, case c_nationkey % 3 when 0 then 'brightness' when 1 then 'depth' else 'vibrancy' end as axis, case when c_custkey % 2 = 0 then 'raise' else 'lower' end as direction, case c_nationkey % 5 when 0 then 3 when 1 then 1 else 2 end as s from customer)"


@query(with_(_INTENT, "g as (select text_id, axis, cast(sum(case when direction = 'raise' then s else -s end) as bigint) as score, max(s) filter (direction = 'raise') as up, max(s) filter (direction = 'lower') as down from i group by all)",
    select="select text_id, axis, score, case when score > 0 then 'raise' when score < 0 then 'lower' end as direction, case case when score > 0 then up when score < 0 then down end when 1 then 'weak' when 2 then 'med' when 3 then 'strong' end as strength, up is not null and down is not null as conflict from g"))
def txt21_merge_intents(spark, sf_dir):
    c = fixtures.table(spark, sf_dir, "customer")
    n = F.col("c_nationkey") % 5
    intents = c.select(F.floor(F.col("c_custkey") / 4).alias("text_id"), F.when(F.col("c_nationkey") % 3 == 0, "brightness").when(F.col("c_nationkey") % 3 == 1, "depth").otherwise("vibrancy").alias("axis"), F.when(F.col("c_custkey") % 2 == 0, "raise").otherwise("lower").alias("direction"), F.when(n == 0, "strong").when(n == 1, "weak").otherwise("med").alias("strength"))
    return preference.merge_intents(intents).drop("has_dislike")


_KEYS = "keys as (select label, arg_min(embedding, vec_id) as embedding, min(vec_id) as key_id from embeddings group by label)"
_COS = "list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double))"


@query(f"""with {_KEYS}, s as (select b.vec_id, a.key_id, {_COS} as sim from keys a, embeddings b), r as (select *, row_number() over (partition by vec_id order by sim desc, key_id) as rank, max(sim) over (partition by vec_id) as best from s)
select vec_id, key_id, round(sim, 6) as sim, rank from r where rank <= 5 and best >= 0.62 and sim >= 0.55""")
def txt5_semantic_top(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "embeddings")
    return preference.semantic_top(e.select("vec_id", "embedding"), fixtures.label_keys(e).select("key_id", "key")).withColumn("sim", F.round("sim", 6))


@query(f"""with {_KEYS}, s as (select b.vec_id, 'axis' || (a.label % 5) as axis, max({_COS}) as sim from keys a, embeddings b group by all), r as (select vec_id, list({{'s': sim, 'a': axis}} order by sim desc, axis desc) as l from s group by vec_id)
select vec_id, case when l[1].s >= 0.35 and l[1].s - coalesce(l[2].s, 0) >= 0.08 then l[1].a end as axis, round(l[1].s, 6) as best, round(l[1].s - coalesce(l[2].s, 0), 6) as margin from r""")
def txt10_axes(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "embeddings")
    d = fixtures.label_keys(e).select(F.concat(F.lit("axis"), (F.col("label") % 5).cast("string")).alias("axis"), "key")
    return preference.classify_axes(e.select("vec_id", "embedding"), d).select("vec_id", "axis", *rounded("best", "margin"))


_NAMES = "nm as (select brand_name as source, shade_name as name, chip_hex as hex from shades where chip_hex is not null union all select brand_name, string_split(shade_name, ' ')[1], chip_hex from shades where chip_hex is not null)"


@query(with_(SHADES, _NAMES,
    "k as (select lower(name) as key, * from nm)", "ph as (select distinct key from k where contains(key, ' '))",
    select="""select key, min({'s': source, 'n': name, 'h': hex}).n as name, count(distinct hex) as n_hex, count(distinct source) as n_sources, least(count(distinct hex), count(distinct source)) as confidence,
  coalesce(any_value(n_phrase), 0) as n_phrase, coalesce(any_value(n_prefix), 0) as n_prefix from k left join (select w as key, count(*) as n_phrase from (select distinct key as p, unnest(string_split(key, ' ')) as w from ph) group by w) a using (key)
  left join (select string_split(key, ' ')[1] as key, count(*) as n_prefix from ph group by 1) b using (key) group by key"""))  # fmt: skip
def ast1_lexicon(spark, sf_dir):
    df = tables.stored(fixtures.shades(spark, sf_dir).where("r is not null").select("brand_name", "shade_name", "chip_hex"), "names")
    names = df.toDF("source", "name", "hex").unionByName(df.select(F.col("brand_name").alias("source"), F.split("shade_name", " ")[0].alias("name"), F.col("chip_hex").alias("hex")))
    return assets.key_index(names).drop("medoid")


@query(with_(SHADES, PROBS, "m as (select *, count(*) filter (p >= 0.55) over (partition by label) as many, row_number() over (partition by label order by p desc, product_id, shade_id) as k from probs where p > 0)",
    select="select label, count(*) as n, round(sum(p*L_lab)/sum(p), 6) as anchor_L, round(sum(p*a_lab)/sum(p), 6) as anchor_a, round(sum(p*b_lab)/sum(p), 6) as anchor_b from m where case when many >= 40 then p >= 0.55 else k <= 250 end group by label having count(*) >= 40"))
def ast5_naming_anchors(spark, sf_dir):
    long = tables.stored(fixtures.naming_long(fixtures.shades(spark, sf_dir)), "naming")
    return assets.naming_anchors(long).select("label", "n", *rounded("anchor_L", "anchor_a", "anchor_b"))


@query(with_(SHADES, PROBS, "m as (select * from probs where p >= 0.55)", select=" union all ".join(f"select label, count(*) as n, '{c}' as axis, round(quantile_cont({c}, 0.05), 5) as q05, round(quantile_cont({c}, 0.5), 5) as q50, round(quantile_cont({c}, 0.95), 5) as q95 from m group by label having count(*) >= 30" for c in ("L_lab", "C_lab", "H_lab_deg"))))
def ast7_distributions(spark, sf_dir):
    long = tables.stored(fixtures.naming_long(fixtures.shades(spark, sf_dir)), "naming")
    q = F.col("q")
    return assets.label_distributions(long).select("label", "n", "axis", F.round(q[0], 5).alias("q05"), F.round(q[3], 5).alias("q50"), F.round(q[6], 5).alias("q95"))


@query(with_(SHADES, select=" union all ".join(f"select '{d}' as dim, round(quantile_cont({d}, 0.35), 5) as low, round(quantile_cont({d}, 0.5), 5) as medium, round(quantile_cont({d}, 0.65), 5) as high, round(quantile_cont({d}, 0.8), 5) as very_high, round(quantile_cont({d}, 0.75) - quantile_cont({d}, 0.25), 5) as iqr, round(stddev_pop({d}), 5) as std from shades where r is not null" for d in THRESHOLDS)))
def ast10_calibration(spark, sf_dir):
    df = tables.stored(fixtures.shades(spark, sf_dir).where("r is not null"), "shades")
    _, dims = assets.build_calibration(df, _prototypes(df).toDF("cluster_id", "L_lab", "a_lab", "b_lab"))
    return dims.select("dim", *rounded("low", "medium", "high", "very_high", "iqr", "std", digits=5))


_Q = LABEL_DISTRIBUTIONS["brown"]
# By direction and strength: places in the quantiles that the bands of the wish snap to, and its weight.
_BAND_AT = {("raise", "weak"): (3, 4, 0.6), ("raise", "med"): (3, 4, 0.85), ("raise", "strong"): (3, 5, 1.0), ("lower", "weak"): (2, 3, 0.6), ("lower", "med"): (2, 3, 0.85), ("lower", "strong"): (1, 3, 1.0)}


def _wished(q, x, direction, strength):
    """SQL of the factor of one wish on the value x of a family with quantiles q, before it is gated."""
    scale, (lo, hi, weight) = max(0.001, abs(q[4] - q[2]) / 2), _BAND_AT[direction, strength]
    steep, away = min(2.5, max(0.6, max(1e-6, abs(q[hi] - q[lo])) / scale)), f"({x} - {q[3]!r})" if direction == "raise" else f"({q[3]!r} - {x})"
    return f"(1 - {weight} + {weight}*(0.55 + 0.45/(1+exp(-least(greatest({steep!r}*{away}/{scale!r}, -12), 12)))))"


_FAMILY_WISHES = [(f"{label} {d} {s}", label, d, s, t) for label in LABEL_DISTRIBUTIONS for (d, s), t in zip(_BAND_AT, ("strong", "weak", "med", "med", "strong", "weak"))]


@query(
    with_(
        SHADES, PROBS,
        "f as (" + " union all ".join(f"select '{q}' as query_id, shade_id, least(greatest((p-0.55)/0.2, 0), 1) as t, {_wished(LABEL_DISTRIBUTIONS[n]['L'], 'L_lab', d, s)} * {_wished(LABEL_DISTRIBUTIONS[n]['C'], 'C_lab', 'lower' if d == 'raise' else 'raise', u)} as f from probs where label = '{n}'" for q, n, d, s, u in _FAMILY_WISHES) + ")",
        select="select query_id, shade_id, round(least(greatest(1 - t*t*(3-2*t) + t*t*(3-2*t)*f, 0), 1), 6) as family_factor from f",
    )
)
def fam5_factor(spark, sf_dir):
    """Each family under brightness wishes of every direction and strength, with one on vibrancy in the other direction."""
    other = {"raise": "lower", "lower": "raise"}
    prefs = [x for q, n, d, s, u in _FAMILY_WISHES for x in ((q, n, "brightness", d, s), (q, n, "vibrancy", other[d], u))]
    prefs = spark.createDataFrame(prefs, "query_id string, label string, axis string, direction string, strength string")
    rows = fixtures.naming_long(fixtures.shades(spark, sf_dir)).join(F.broadcast(prefs.select("query_id", "label").distinct()), "label")
    got = scoring.family_factor(rows, scoring.family_specs(prefs), calibration.label_distributions(spark))
    return got.select("query_id", "shade_id", F.round("family_factor", 6).alias("family_factor"))


@query()
def mlp8_ranker(spark, sf_dir):
    df = tables.stored(fixtures.shades(spark, sf_dir).where("r is not null"), "ranker")
    labels = relational.top_fractions(df, "cluster_id", "C_lab", "shade_id")
    rows = tables.stored(learning.stratified_split(labels, ["product_id", "shade_id"]), "split")
    model = learning.linear_ranker(rows.where("split = 'train'"), iterations=200)
    return aggregates.auc_ap(learning.predictions(model, rows.where("split = 'test'")), "label", "p").select(F.round("auc", 3).alias("auc"), F.round("ap", 3).alias("ap"))


@query()
def mlp9_ranker(spark, sf_dir):
    """Boosted trees on the rows of mlp8_ranker, stopped by the valid rows; how they do on the test rows, and how many trees they are."""
    df = tables.stored(fixtures.shades(spark, sf_dir).where("r is not null"), "ranker")
    labels = relational.top_fractions(df, "cluster_id", "C_lab", "shade_id")
    rows = tables.stored(learning.stratified_split(labels, ["product_id", "shade_id"]), "split")
    model = learning.boosted_ranker(rows.where("split = 'train'"), rows.where("split = 'valid'"))
    got = aggregates.auc_ap(learning.predictions(model, rows.where("split = 'test'")), "label", "p")
    return got.select(F.round("auc", 3).alias("auc"), F.round("ap", 3).alias("ap"), F.lit(model.stages[-1].getNumTrees).alias("trees"))


def _lloyd_sql(rounds: int) -> tuple[str, ...]:
    """SQL of the rounds of the prototypes, from the fixed naming colours."""
    start = ", ".join(f"({k}, {L!r}::double, {a!r}::double, {b!r}::double)" for k, (_, L, a, b) in enumerate(fixtures.NAMES))
    parts = ["lc as materialized (select L_lab, a_lab, b_lab, count(*) as n from shades where r is not null group by all)", f"c0 as materialized (select * from (values {start}) v(k, l, a, b))"]
    near = "arg_min(k, {'d': round(power(L_lab - l, 2) + power(a_lab - a, 2) + power(b_lab - b, 2), 9), 'k': k})"
    for i in range(rounds):
        parts += [
            f"m{i} as materialized (select L_lab, a_lab, b_lab, any_value(lc.n) as n, {near} as k from lc, c{i} group by L_lab, a_lab, b_lab)",
            f"c{i + 1} as materialized (select c.k, coalesce(g.l, c.l) as l, coalesce(g.a, c.a) as a, coalesce(g.b, c.b) as b, coalesce(g.n, 0) as n from c{i} c left join (select k, sum(L_lab*n)/sum(n) as l, sum(a_lab*n)/sum(n) as a, sum(b_lab*n)/sum(n) as b, sum(n) as n from m{i} group by k) g using (k))",
        ]
    return tuple(parts)


@query(with_(SHADES, *_lloyd_sql(20), select="select cast(k as int) as cluster_id, round(l, 5) as L_lab, round(a, 5) as a_lab, round(b, 5) as b_lab, cast(n as bigint) as n from c20"))
def ast11_prototypes(spark, sf_dir):
    """Twenty rounds at most from the naming colours."""
    starts = spark.createDataFrame([(k, *n[1:]) for k, n in enumerate(fixtures.NAMES)], "cluster_id int, L_lab double, a_lab double, b_lab double")
    got, _ = assets.prototypes(tables.stored(fixtures.shades(spark, sf_dir), "shades"), starts)
    return got.select("cluster_id", *rounded("L_lab", "a_lab", "b_lab", digits=5), "n")


@query()
def fun9_fuzzy(spark, sf_dir):
    part = fixtures.table(spark, sf_dir, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word"))
    return udf.fuzzy_matches(part, part.select(F.col("word").alias("key")), 80.0)


@query(with_(SHADES, ANCHORS, PAIRS, select="select query_id, shade_id, round(L_lab, 6) as L_lab, round(de00, 5) as de00 from pairs where de00 <= 25"))
def udf3_sql_functions(spark, sf_dir):
    """The colour functions called in SQL."""
    udf.register_sql(spark)
    tables.stored(fixtures.shades(spark, sf_dir).select("shade_id", "chip_hex"), "chips").createOrReplaceTempView("chips")
    fixtures.anchors(spark).createOrReplaceTempView("anchors")
    return spark.sql("""
      with s as (select shade_id, hex_to_lab(chip_hex) as c from chips where chip_hex is not null), a as (select query_id, hex_to_lab(anchor_hex) as c from anchors),
      e as (select query_id, shade_id, s.c.L as l, delta_e00(s.c.L, s.c.a, s.c.b, a.c.L, a.c.a, a.c.b) as x from s cross join a),
      d as (select query_id, shade_id, l, explode(array(x)) as de from e)  -- keeps the filter from copying the formula
      select query_id, shade_id, round(l, 6) as L_lab, round(de, 5) as de00 from d where de <= 25""")


@F.pandas_udf(StringType())
def _first_cue(text: pd.Series) -> pd.Series:
    """A backend for the test of backends: dislike after "not", like after "want"."""
    return text.str.lower().map(lambda t: None if t is None else "dislike" if " not " in f" {t} " else "like" if "want" in t else "no idea")


@query("with " + _WISH + " select text_id, case when contains(' ' || lower(text) || ' ', ' not ') then 'DISLIKE' when contains(lower(text), 'want') then 'LIKE' else 'UNKNOWN' end as polarity from w")
def udf1_polarity(spark, sf_dir):
    """A polarity backend by name."""
    udf.register_polarity(spark, "first_cue", _first_cue)
    return texts(spark, sf_dir).select("text_id", udf.polarity_by("first_cue", F.col("text")).alias("polarity"))


@query(f"""with {_KEYS}, s as (select b.vec_id, 'axis' || (a.label % 3) as axis, max({_COS}) as sim from keys a, embeddings b where a.label % 5 < 3 group by all), r as (select vec_id, list({{'s': sim, 'a': axis}} order by sim desc, axis desc) as l from s group by vec_id)
select vec_id, case when l[1].s >= 0.35 and l[1].s - coalesce(l[2].s, 0) >= 0.08 then l[1].a end as axis from r""")
def udf1_axes(spark, sf_dir):
    """An axis model by name."""
    e = fixtures.table(spark, sf_dir, "embeddings")
    model = fixtures.label_keys(e).where("label % 5 < 3").select(F.concat(F.lit("axis"), (F.col("label") % 3).cast("string")).alias("axis"), "key")
    udf.register_axis_model(model, "three")
    return udf.axes_by("three", e.select("vec_id", "embedding")).select("vec_id", "axis")
