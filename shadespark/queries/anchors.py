"""Alias index, base anchors, mention and label anchors, and the reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import pools, preference, relational
from ..plans import anchors, assets, reports
from ..sources import fixtures, tables
from .base import _ANCHOR_LIST, ANCHORS, PROBS, SHADES, query, rounded, with_
from .ranking import _ELIGIBLE, _NAMES, _WISH, _pairs, texts

_COLOURS = tuple(a[0] for a in fixtures.ANCHORS)
_COLOUR_LIST = "[" + ", ".join(f"'{n}'" for n in _COLOURS) + "]"


def _lab_sql(name: str, source: str) -> str:
    """CTEs that end in name: the rows of source (hex, ...) with L_lab, a_lab, b_lab, C_lab."""
    lin = lambda c: f"case when {c} <= 0.04045 then {c}/12.92 else power(({c}+0.055)/1.055, 2.4) end"
    f = lambda t: f"case when {t} > 216e0/24389 then cbrt({t}) else {t}*841e0/108 + 4e0/29 end"
    return f"""{name}0 as (select *, ('0x' || hex[2:3])::int/255e0 as ar, ('0x' || hex[4:5])::int/255e0 as ag, ('0x' || hex[6:7])::int/255e0 as ab from {source}),
{name}1 as (select *, {lin("ar")} as lr, {lin("ag")} as lg, {lin("ab")} as lb from {name}0),
{name}2 as (select *, (0.4124564*lr + 0.3575761*lg + 0.1804375*lb)/0.95047 as x1, 0.2126729*lr + 0.7151522*lg + 0.0721750*lb as y1, (0.0193339*lr + 0.1191920*lg + 0.9503041*lb)/1.08883 as z1 from {name}1),
{name}3 as (select *, {f("x1")} as fx, {f("y1")} as fy, {f("z1")} as fz from {name}2),
{name} as (select * exclude (ar, ag, ab, lr, lg, lb, x1, y1, z1, fx, fy, fz), 116*fy - 16 as L_lab, 500*(fx-fy) as a_lab, 200*(fy-fz) as b_lab, sqrt(power(500*(fx-fy),2)+power(200*(fy-fz),2)) as C_lab from {name}3)"""


#: A word for a shade's tone, so that some words of the lexicon stand for pale or light colours.
_TONE = "case when L_lab > 78 then 'light' when C_lab < 35 then 'muted' else 'strong' end"


def _names(spark, sf_dir):
    """(source, name, hex): shade names, and their first words with every shade's colour."""
    df = tables.stored(fixtures.shades(spark, sf_dir).where("r is not null").select("brand_name", "shade_name", "chip_hex"), "names")
    return df.toDF("source", "name", "hex").unionByName(df.select(F.col("brand_name").alias("source"), F.split("shade_name", " ")[0].alias("name"), F.col("chip_hex").alias("hex")))


@query(
    with_(
        SHADES, _NAMES,
        "one as (select lower(string_split(name, ' ')[1]) as alias, min(hex) as hex, 'base' as source from nm group by 1)",
        "two as (select lower(name) as alias, min(hex) as hex, 'extra' as source from nm group by 1)",
        "fr as (select w as alias, count(*) as f from (select unnest(string_split(alias, ' ')) as w from (select alias from one union select alias from two) where contains(alias, ' ')) group by w)",
        "lim as (select percentile_disc(0.5) within group (order by f desc) as m from fr)",
        "ch as (select t.* from two t left join fr using (alias), lim where contains(t.alias, ' ') or (length(t.alias) >= 3 and m is not null and (t.alias in (select alias from one) or coalesce(f, 0) >= greatest(3, m))))",
        "al as (select * from ch union all select * from one where alias not in (select alias from ch))",
        _lab_sql("x", "al"),
        select="select alias, source, hex, round(L_lab, 6) as L_lab, round(C_lab, 6) as C_lab from x",
    )
)
def txt28_aliases(spark, sf_dir):
    names = _names(spark, sf_dir)
    base = names.select(F.split("name", " ")[0].alias("name"), "hex")
    return anchors.alias_index(base, names.select("name", "hex")).select("alias", "source", "hex", *rounded("L_lab", "C_lab"))


@query(
    with_(
        SHADES, _NAMES,
        f"tn as (select brand_name as source, {_TONE} as tone, shade_name, chip_hex as hex from shades where r is not null)",
        "k as (select distinct lower(name) as key, hex from (select name, hex from nm union all select tone, hex from tn union all select tone || ' ' || shade_name, hex from tn))",
        _lab_sql("kl", "k"),
        "mn as (select *, avg(L_lab) over w as ml, avg(a_lab) over w as ma, avg(b_lab) over w as mb from kl where not contains(key, ' ') window w as (partition by key))",
        "own as (select key, arg_min({'h': hex, 'l': L_lab, 'c': C_lab}, {'d': round(power(L_lab-ml,2)+power(a_lab-ma,2)+power(b_lab-mb,2), 9), 'h': hex}) as o from mn group by key)",
        "pv as (select distinct w as key, hex, L_lab, a_lab, b_lab, C_lab from (select *, unnest(string_split(key, ' ')) as w from kl where contains(key, ' ')) where round(L_lab, 6) <= 80)",
        "vr as (select pv.* from pv join own using (key) where round(o.c, 6) < 35 or round(o.l, 6) > 78)",
        "mk as (select key, count(*) as n, quantile_cont(C_lab, 0.3) as c3, quantile_cont(C_lab, 0.5) as c5, quantile_cont(C_lab, 0.6) as c6, quantile_cont(C_lab, 0.7) as c7, quantile_cont(L_lab, 0.5) as l5 from vr group by key having count(*) >= 8)",
        "v2 as (select *, case when round(c5, 6) <= 28 then round(C_lab, 6) between round(c3, 6) and round(c7, 6) else round(C_lab, 6) >= round(c6, 6) end as ins from vr join mk using (key))",
        "v3 as (select *, row_number() over (partition by key order by round(abs(L_lab-l5) + 0.8*abs(C_lab-c5), 6), hex) as k from (select *, count(*) filter (ins) over (partition by key) as lft from v2) where ins or lft < 8)",
        "v4 as (select *, avg(L_lab) over w as ml, avg(a_lab) over w as ma, avg(b_lab) over w as mb from v3 where round(c5, 6) > 28 or k <= 25 window w as (partition by key))",
        "me as (select key, arg_min(hex, {'d': round(power(L_lab-ml,2)+power(a_lab-ma,2)+power(b_lab-mb,2), 9), 'h': hex}) as hex from v4 group by key)",
        select="select own.key, coalesce(me.hex, o.h) as hex, case when me.hex is null then 'own' else 'variants' end as policy from own left join me using (key)",
    )
)
def ast2_base_anchors(spark, sf_dir):
    df = fixtures.shades(spark, sf_dir).where("r is not null").select(F.col("brand_name").alias("source"), F.expr(_TONE).alias("tone"), "shade_name", F.col("chip_hex").alias("hex"))
    df = tables.stored(df.distinct(), "tones")
    said = F.array("shade_name", F.split("shade_name", " ")[0], "tone", F.concat_ws(" ", "tone", "shade_name"))
    names = tables.stored(df.select("source", F.explode(said).alias("name"), "hex"), "names")
    return anchors.stabilised_bases(tables.stored(assets.key_index(names), "index"), names)


def _references(spark):
    return fixtures.anchors(spark).select(F.col("query_id").alias("label"), F.col("anchor_hue").alias("hue"))


def _labels(spark, sf_dir):
    """(plain, vivid) label anchors, of one table."""
    columns = ("label", "p", "product_id", "shade_id", "chip_hex", "L_lab", "a_lab", "b_lab", "C_lab")
    members = tables.stored(anchors.members(fixtures.naming_long(fixtures.shades(spark, sf_dir)).select(*columns)), "naming")
    return anchors.label_anchors(members, _references(spark)), anchors.label_anchors(members, _references(spark), 0.9)


_MEMBERS = """
m0 as (select *, count(*) filter (p >= 0.55) over w as many, count(*) over w as alln from probs where p > 0 window w as (partition by label)),
m1 as (select *, row_number() over (partition by label order by p desc, product_id, shade_id) as k from m0 where alln >= 40),
m as (select * from m1 where case when many >= 40 then p >= 0.55 else k <= 250 end),
hm as (select m.*, round(abs((((hue_hsv_deg - anchor_hue + 180) % 360 + 360) % 360) - 180), 6) as d from m join anchors on query_id = label where label = 'brown'),
h1 as (select *, count(*) filter (d <= 28) over (partition by label) as nb, row_number() over (partition by label order by d, product_id, shade_id) as kd from hm),
h2 as (select *, round(quantile_cont(d, 0.9) over (partition by label), 6) as far from h1 where case when nb >= 40 then d <= 28 else kd <= 40 end),
h3 as (select * from (select *, count(*) filter (d <= far) over (partition by label) as ni from h2) where d <= far or ni < 40),
hue as (select label, count(*) as n, sum(w*L_lab)/sum(w) as anchor_L, sum(w*a_lab)/sum(w) as anchor_a, sum(w*b_lab)/sum(w) as anchor_b from (select *, p*exp(-power(d/14, 2)) as w from h3) group by label),
base as (select label, count(*) as n, sum(p*L_lab)/sum(p) as anchor_L, sum(p*a_lab)/sum(p) as anchor_a, sum(p*b_lab)/sum(p) as anchor_b from m where label <> 'brown' group by label union all select * from hue),
v0 as (select *, round(sum(p) over (partition by label order by round(C_lab, 4)) / sum(p) over (partition by label), 9) as share from m where label <> 'brown'),
v1 as (select *, min(round(C_lab, 4)) filter (share >= 0.9) over (partition by label) as t from v0),
v2 as (select *, count(*) filter (round(C_lab, 4) >= t) over (partition by label) as nt, row_number() over (partition by label order by round(C_lab, 4) desc, product_id, shade_id) as kc from v1),
vivid as (select label, count(*) as n, sum(p*L_lab)/sum(p) as anchor_L, sum(p*a_lab)/sum(p) as anchor_a, sum(p*b_lab)/sum(p) as anchor_b from v2 where case when nt >= 40 then round(C_lab, 4) >= t else kc <= 40 end group by label union all select * from hue)
"""


@query(with_(SHADES, ANCHORS, PROBS, _MEMBERS, select=" union all ".join(f"select label, '{t}' as form, n, round(anchor_L, 5) as anchor_L, round(anchor_a, 5) as anchor_a, round(anchor_b, 5) as anchor_b from {t}" for t in ("base", "vivid"))))
def ast5_label_anchors(spark, sf_dir):
    base, vivid = _labels(spark, sf_dir)
    both = base.withColumn("form", F.lit("base")).unionByName(vivid.withColumn("form", F.lit("vivid")))
    return both.select("label", "form", "n", *rounded("anchor_L", "anchor_a", "anchor_b", digits=5))


# Mentions, constraints and axis scores drawn from orders and their lines; a name's candidates are its own colour and the next one of the list.
_SAID = (
    f"men as (select o_orderkey // 3 as text_id, o_orderkey as start, ({_COLOUR_LIST})[o_custkey % 17 + 1] as name, case o_orderkey % 7 when 0 then 'brand' else 'color' end as kind, case o_custkey % 3 when 0 then 'LIKE' when 1 then 'DISLIKE' else 'UNKNOWN' end as polarity, (o_custkey % 10)/10e0 as confidence from orders)",
    f"lst as (select (row_number() over ()) - 1 as i, * from (values {_ANCHOR_LIST}) v(name, hex))",
    "cnd as (select name, 1.0::double as score, hex from lst union all select a.name, 0.99 - (a.i % 4)*0.01, b.hex from lst a join lst b on b.i = (a.i + 1) % 17)",
    _lab_sql("cl", "cnd"),
    "res as (select name, arg_max({'x': hex, 'l': L_lab, 'a': a_lab, 'b': b_lab}, {'c': round(C_lab, 6), 's': round(-score, 9), 'h': hex}) as r from cl where round(score, 9) >= 0.97 group by name)",
    "fnd as (select text_id, count(*) as n_colours, count(*) = 1 as plain, arg_min(name, start) as token, arg_max(r, {'c': confidence, 's': -start, 'n': name}) as r from men join res using (name) where kind = 'color' and polarity <> 'DISLIKE' group by text_id)",
)


def _found(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    polarity = F.when(c % 3 == 0, "LIKE").when(c % 3 == 1, "DISLIKE").otherwise("UNKNOWN")
    said = fixtures.table(spark, sf_dir, "orders").select(F.floor(k / 3).alias("text_id"), k.alias("start"), F.element_at(F.array(*map(F.lit, _COLOURS)), (c % 17 + 1).cast("int")).alias("name"), F.when(k % 7 == 0, "brand").otherwise("color").alias("kind"), polarity.alias("polarity"), ((c % 10) / 10).alias("confidence"))
    n = len(fixtures.ANCHORS)
    rows = [(name, 1.0, hexed) for name, hexed in fixtures.ANCHORS] + [(fixtures.ANCHORS[i][0], 0.99 - (i % 4) * 0.01, fixtures.ANCHORS[(i + 1) % n][1]) for i in range(n)]
    return anchors.mention_anchors(said, spark.createDataFrame(rows, "name string, score double, hex string"))


@query(with_(*_SAID, select="select text_id, n_colours, plain, token, r.x as anchor_hex, round(r.l, 6) as anchor_L, round(r.a, 6) as anchor_a, round(r.b, 6) as anchor_b from fnd"))
def txt27_mention_anchors(spark, sf_dir):
    return _found(spark, sf_dir).select("text_id", "n_colours", "plain", "token", "anchor_hex", *rounded("anchor_L", "anchor_a", "anchor_b"))


_ASKED = (
    "con as (select (o_orderkey * 2) // 3 as text_id, (['saturation', 'vibrancy', 'brightness', 'depth', 'warmth'])[o_custkey % 5 + 1] as axis, case o_custkey % 2 when 0 then 'raise' else 'lower' end as direction from orders)",
    "rnk as (select l_orderkey as text_id, max(l_quantity) as top, max(l_quantity) filter (l_partkey % 4 in (1, 2)) as hi from lineitem group by 1)",
    "flg as (select text_id, count(*) = 1 and min(direction) = 'raise' and (min(axis) in ('saturation', 'vibrancy') or (min(axis) = 'brightness' and coalesce(any_value(round(top/50 - hi/50, 9) <= 0.03), false))) as hi_chroma from con left join rnk using (text_id) group by text_id)",
)


def _flags(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cons = fixtures.table(spark, sf_dir, "orders").select(F.floor(k * 2 / 3).alias("text_id"), F.element_at(F.array(*map(F.lit, ("saturation", "vibrancy", "brightness", "depth", "warmth"))), (c % 5 + 1).cast("int")).alias("axis"), F.when(c % 2 == 0, "raise").otherwise("lower").alias("direction"))
    axis = F.element_at(F.array(*map(F.lit, ("brightness", "saturation", "vibrancy", "depth"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    scores = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("text_id"), axis.alias("axis"), (F.col("l_quantity") / 50).cast("double").alias("score"))
    return anchors.hi_chroma(cons, scores)


@query(with_(*_ASKED, select="select text_id, hi_chroma from flg"))
def pol13_hi_chroma(spark, sf_dir):
    return _flags(spark, sf_dir)


@query(
    with_(
        SHADES, ANCHORS, PROBS, _MEMBERS, *_SAID, *_ASKED,
        "e as (select text_id, token, plain, coalesce(hi_chroma, false) as hi_chroma, r, case when plain or coalesce(hi_chroma, false) then case when coalesce(hi_chroma, false) then {'l': vivid.anchor_L, 'a': vivid.anchor_a, 'b': vivid.anchor_b} else {'l': base.anchor_L, 'a': base.anchor_a, 'b': base.anchor_b} end end as t from fnd left join flg using (text_id) left join base on base.label = token left join vivid on vivid.label = token)",
        select="select text_id, token, plain, hi_chroma, t.l is not null as used, r.x as anchor_hex, round(coalesce(t.l, r.l), 5) as anchor_L, round(coalesce(t.a, r.a), 5) as anchor_a, round(coalesce(t.b, r.b), 5) as anchor_b from e",
    )
)
def pol13_effective(spark, sf_dir):
    got = anchors.effective_anchors(_found(spark, sf_dir), _flags(spark, sf_dir), *_labels(spark, sf_dir))
    return got.select("text_id", "token", "plain", "hi_chroma", "used", "anchor_hex", *rounded("anchor_L", "anchor_a", "anchor_b", digits=5))


@query(
    with_(
        SHADES, ANCHORS, _ELIGIBLE,
        "tl as (select quantile_cont(C_lab, 0.9) as c9, quantile_cont(L_lab, 0.1) as l1, quantile_cont(L_lab, 0.9) as l9 from shades where r is not null)",
        "tp as (select *, count(*) filter (de00 <= base) over (partition by query_id) < 20 as low, row_number() over (partition by query_id order by round(de00, 9), product_id, shade_id) as rank from pairs)",
        "g as (select query_id, avg((C_lab > c9)::int) as c, avg((L_lab < l1 or L_lab > l9)::int) as l, quantile_cont(abs((((degrees(atan2(round(b_lab,10), round(a_lab,10))) - degrees(atan2(round(anchor_b,10), round(anchor_a,10))) + 180) % 360 + 360) % 360) - 180), 0.5) as d, bool_or(low) as low from tp, tl where rank <= 10 group by query_id)",
        select="select query_id, case when c is null then 'EMPTY' else 'OK' end as status, round(c, 6) as c_extreme, round(l, 6) as l_extreme, round(d, 5) as hue_drift, low as low_coverage, coalesce(c is null or c >= 0.25 or l >= 0.25 or (not low and round(d, 6) >= 35), false) as failed from anchors left join g using (query_id)",
    )
)
def eva8_neutrality(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    low = pools.coverage(pairs).select("query_id", (F.col("n_within") < 20).alias("low_coverage"))
    top = relational.top_per(pairs, ["query_id"], [F.round("de00", 9), "product_id", "shade_id"], 10).join(F.broadcast(low), "query_id")
    catalogue = tables.stored(fixtures.shades(spark, sf_dir).where("r is not null").select("L_lab", "C_lab"), "tails")
    got = reports.neutrality(top, catalogue, fixtures.anchors(spark))
    return got.select("query_id", "status", *rounded("c_extreme", "l_extreme"), F.round("hue_drift", 5).alias("hue_drift"), "low_coverage", "failed")


@query(with_(_WISH, select=f"select ({_COLOUR_LIST})[text_id % 17 + 1] as token, count(*) as n_texts, count(distinct text_id % 4) as n_forms, 1::bigint as n_anchors, 'PASS' as status from w group by 1"))
def eva11_anchor_grid(spark, sf_dir):
    said = texts(spark, sf_dir)
    names = fixtures.anchors(spark).select(F.col("query_id").alias("name"), F.col("query_id").alias("alias"), F.lit(1.0).alias("score"), F.col("anchor_hex").alias("hex"))
    found = preference.mentions(said, names.select("alias", "name")).select("text_id", "start", "name", F.lit("color").alias("kind"), F.lit("UNKNOWN").alias("polarity"), F.lit(1.0).alias("confidence"))
    return reports.anchor_grid(anchors.mention_anchors(found, names.select("name", "score", "hex")), said.select("text_id", (F.col("text_id") % 4).alias("form")))


@query(with_(SHADES, ANCHORS, PROBS, _MEMBERS, select="select label, round(sqrt(power(v.anchor_a,2)+power(v.anchor_b,2)) - sqrt(power(b.anchor_a,2)+power(b.anchor_b,2)), 5) as d_chroma, case when round(sqrt(power(v.anchor_a,2)+power(v.anchor_b,2)) - sqrt(power(b.anchor_a,2)+power(b.anchor_b,2)), 6) >= 0 then 'PASS' else 'FAIL' end as status from base b join vivid v using (label)"))
def eva12_anchor_effects(spark, sf_dir):
    return reports.anchor_effects(*_labels(spark, sf_dir)).select("label", F.round("d_chroma", 5).alias("d_chroma"), "status")


@query("""with k as (select label, arg_min(embedding, vec_id) as key from embeddings group by label),
s as (select cast(label as varchar) as label, 'v' || cast(vec_id as varchar) as variant, list_cosine_similarity(list_transform(embedding, lambda x: x::double), list_transform(key, lambda x: x::double)) as weight from embeddings join k using (label))
select label, variant, round(weight, 6) as weight from s where round(weight, 9) >= 0.75 union all select cast(label as varchar), cast(label as varchar), 1.0 from k""")
def txt11_variants(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    variants = e.select("label", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("variant"), "embedding")
    return preference.filter_variants(variants, fixtures.label_keys(e).select("label", "key")).withColumn("weight", F.round("weight", 6))


@query(
    """with s as (select l_orderkey as text_id, (['depth', 'brightness', 'clarity', 'saturation', 'vibrancy', 'warmth'])[l_partkey % 6 + 1] as axis, max(l_quantity)/50 as score from lineitem group by all),
r as (select *, row_number() over (partition by text_id order by score desc, axis) as k, case when axis in ('brightness', 'depth') then 'LIGHTNESS' when axis in ('saturation', 'vibrancy') then 'CHROMA' else 'OTHER' end as f from s),
g as (select text_id, any_value(axis) filter (k = 1) as a1, any_value(axis) filter (k = 2) as a2, any_value(f) filter (k = 1) as f1, any_value(f) filter (k = 2) as f2, any_value(score) filter (k = 1) as s1, coalesce(any_value(score) filter (k = 2), 0) as s2,
  arg_min(axis, k) filter (k <= 3 and f = 'LIGHTNESS') as al, max(score) filter (k <= 3 and f = 'LIGHTNESS') as sl from r group by text_id),
t as (select *, case when s1 < 0.35 then 'min_sim' when round(s1 - s2, 9) >= 0.08 then 'strict' when a2 is null then 'no_ranked' when round(s1 - s2, 9) < 0.02 then 'too_flat'
  when f1 = f2 and f1 = 'CHROMA' and round(s1 - sl, 9) <= 0.03 then 'family_bias_lightness' when f1 = f2 and f1 <> 'OTHER' then 'family' else 'fail_family' end as gate from g)
select text_id, case when gate in ('strict', 'family') then a1 when gate = 'family_bias_lightness' then al end as axis, gate from t"""
)
def txt12_gate(spark, sf_dir):
    axis = F.element_at(F.array(*map(F.lit, ("depth", "brightness", "clarity", "saturation", "vibrancy", "warmth"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    scores = fixtures.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("text_id"), axis.alias("axis")).agg((F.max("l_quantity") / 50).cast("double").alias("score"))
    return preference.gate_axes(scores, "text_id")
