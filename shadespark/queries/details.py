"""Votes, medoids, families, breakdowns and joins that other queries only pass through."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import aggregates, constraints, pools, preference, relational, scoring
from ..plans import assets, learning, recommend
from ..sources import calibration, fixtures, tables
from ..sources.calibration import DELTA_E_REF, PREFERENCE_WEIGHTS, SCALE_IQR
from .base import ANCHORS, PROBS, SHADES, query, rounded, with_
from .ranking import _CONS, _ELIGIBLE, _GUARD, _NAMES, _PROTO, _Q, _SCORED, _wished, _blobs, _pairs, _prototypes


def _catalogue(spark, sf_dir, *columns):
    df = fixtures.shades(spark, sf_dir).where("r is not null")
    return tables.stored(df.select(*columns) if columns else df, "shades")


@query(with_(SHADES, PROBS, "m as (select *, sum(p*a_lab) over w / sum(p) over w as ma, sum(p*b_lab) over w / sum(p) over w as mb from probs window w as (partition by label))",
    select="select label, arg_min(chip_hex, {'d': round(power(a_lab-ma,2)+power(b_lab-mb,2), 9), 'k': chip_hex}) as medoid from m group by label"))
def agg7_weighted_medoid(spark, sf_dir):
    long = tables.stored(fixtures.naming_long(fixtures.shades(spark, sf_dir)), "naming")
    return aggregates.lab_medoids(long, ["label"], "chip_hex", "chip_hex", F.col("p"), ("a_lab", "b_lab"))


_AXES = "(['depth', 'brightness', 'clarity', 'saturation', 'vibrancy'])"


@query(f"""with v as (select l_orderkey as label, {_AXES}[l_partkey % 5 + 1] as axis, (l_quantity / 50)::double as score, (l_suppkey % 7 + 1)::double as weight from lineitem),
a as (select label, axis, sum(weight*score)/sum(weight) as score from v group by all)
select label, axis, round(score, 6) as score, round(max(score) over (partition by label) - score, 6) as margin from a""")
def agg22_vote(spark, sf_dir):
    axis = F.element_at(F.array(*map(F.lit, ("depth", "brightness", "clarity", "saturation", "vibrancy"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("label"), (F.col("l_suppkey") % 7 + 1).cast("double").alias("weight"), F.array(F.struct(axis.alias("axis"), (F.col("l_quantity") / 50).cast("double").alias("score"))).alias("axes"))
    voted = preference.weighted_vote(rows)
    best = voted.groupBy("label").agg(F.max("score").alias("_best"))
    return voted.join(best, "label").select("label", "axis", F.round("score", 6).alias("score"), F.round(F.col("_best") - F.col("score"), 6).alias("margin"))


_INDEX = (
    SHADES, _NAMES, "k as (select lower(name) as key, * from nm)", "ph as (select distinct key from k where contains(key, ' '))",
    """ix as (select key, count(distinct hex) as n_hex, count(distinct source) as n_sources, coalesce(any_value(n_phrase), 0) as n_phrase, coalesce(any_value(n_prefix), 0) as n_prefix from k
  left join (select w as key, count(*) as n_phrase from (select distinct key as p, unnest(string_split(key, ' ')) as w from ph) group by w) a using (key) left join (select string_split(key, ' ')[1] as key, count(*) as n_prefix from ph group by 1) b using (key) group by key)""",
)


def _named(spark, sf_dir):
    df = _catalogue(spark, sf_dir, "brand_name", "shade_name", "chip_hex")
    return df.toDF("source", "name", "hex").unionByName(df.select(F.col("brand_name").alias("source"), F.split("shade_name", " ")[0].alias("name"), F.col("chip_hex").alias("hex")))


@query(with_(*_INDEX, "md as (select key from ix where not contains(key, ' ') and n_phrase >= 2 and n_prefix >= 2 and n_prefix / n_phrase >= 0.8 and least(n_hex, n_sources) <= 1000 and n_sources <= 1000 and n_hex <= 1000)",
    select="select key, false as kept from md union all select key, true from ix where key not in (select key from md) and key not in (select lower(p_name) from part where p_size = 7)"))
def ast3_modifiers(spark, sf_dir):
    """The lexicon without modifier-like words and denied keys, and those words, at limits that fit this small vocabulary."""
    denied = fixtures.table(spark, sf_dir, "part").where("p_size = 7").select(F.lower("p_name").alias("key"))
    kept, dropped = assets.build_lexicon(_named(spark, sf_dir), denied, phrase=2, prefix=2, most=1000)
    return kept.select("key", F.lit(True).alias("kept")).unionByName(dropped.select("key", F.lit(False).alias("kept")))


@query(with_(
    *_INDEX, "hx as (select distinct chip_hex as hex, L_lab, a_lab, b_lab, C_lab from shades where r is not null)",
    "v as (select distinct w as word, hex from (select unnest(string_split(key, ' ')) as w, hex from k where contains(key, ' ')))",
    "f as (select v.*, L_lab, a_lab, b_lab, C_lab from v join hx using (hex) where L_lab between 35 and 85 and C_lab <= 45)",
    "q as (select *, quantile_cont(C_lab, 0.75) over (partition by word) as q, count(*) over (partition by word) as n from f)",
    "g as (select *, count(*) filter (round(C_lab, 9) <= round(q, 9)) over (partition by word) as lft from q)",
    "h as (select *, avg(L_lab) over w as ml, avg(a_lab) over w as ma, avg(b_lab) over w as mb from g where n >= 6 and (round(C_lab, 9) <= round(q, 9) or lft < 6) and word in (select key from ix where n_phrase >= 3) window w as (partition by word))",
    select="select word, arg_min(hex, {'d': round(power(L_lab-ml,2)+power(a_lab-ma,2)+power(b_lab-mb,2), 9), 'k': hex}) as medoid from h group by word"))
def ast4_descriptors(spark, sf_dir):
    names = tables.stored(_named(spark, sf_dir), "names")
    return assets.descriptors(tables.stored(assets.key_index(names), "index"), names, phrases=3)


@query(with_(
    SHADES, "nm as (select shade_id, string_split(shade_name, ' ')[1] as label, L_lab, a_lab, b_lab from shades where r is not null)",
    "pv as (select label, median(L_lab) as l0, median(a_lab) as a0, median(b_lab) as b0 from nm group by label having count(*) >= 5)",
    select="select shade_id, arg_min(pv.label, {'d': round(power(L_lab-l0,2)+power(a_lab-a0,2)+power(b_lab-b0,2), 9), 'q': pv.label}) as nearest from nm, pv where (select count(*) from pv) >= 3 group by shade_id"))
def ast8_pivots(spark, sf_dir):
    names = _catalogue(spark, sf_dir, "shade_id", F.split("shade_name", " ")[0].alias("label"), "L_lab", "a_lab", "b_lab")
    return assets.pivot_labels(names, least=5, pivots=3).select("shade_id", "nearest")


def _near(q, x, hue):
    """SQL of a toward score with target .5 and span .25."""
    half = abs(q[4] - q[2]) / 2
    radius = max(10.0 if hue else 1e-6, half)
    away = f"abs(((({x} - {q[3]!r} + 180) % 360 + 360) % 360) - 180)" if hue else f"abs({x} - {q[3]!r})"
    return f"(case when {away} >= {radius!r} then 0 else power(1 - {away}/{radius!r}, 2)*(3 - 2*(1 - {away}/{radius!r})) end)"


@query(with_(SHADES, PROBS, select=f"select shade_id, round(least(greatest(1 - gm + gm*(0.4 + 0.6*(0.55 + 0.45*{_near(_Q['h'], 'H_lab_deg', True)}))*(0.2 + 0.8*(0.55 + 0.45*{_near(_Q['C'], 'C_lab', False)})), 0), 1), 6) as family_factor from (select *, t*t*(3-2*t) as gm from (select *, least(greatest((p-0.55)/0.2, 0), 1) as t from probs where label = 'brown'))"))
def fam4_near(spark, sf_dir):
    rows = fixtures.naming_long(fixtures.shades(spark, sf_dir)).where("label = 'brown'").withColumn("query_id", F.lit("q"))
    specs = spark.createDataFrame([("q", "brown", "h", "toward", 0.6, 0.25, 0.75, 0.5, 0.25), ("q", "brown", "C", "near", 0.8, 0.25, 0.75, 0.5, 0.25)], "query_id string, label string, axis string, direction string, strength double, q_lo double, q_hi double, q_target double, q_span double")
    got = scoring.family_factor(rows, specs, calibration.label_distributions(spark))
    return got.select("shade_id", F.round("family_factor", 6).alias("family_factor"))


_FACTOR = "ff as (select *, least(greatest(1 - t*t*(3-2*t) + t*t*(3-2*t)*f, 0), 1) as ff from (select *, least(greatest((p-0.55)/0.2, 0), 1) as t, " + _wished(_Q["L"], "L_lab", "lower", "strong") + " as f from probs where label = 'brown'))"


@query(with_(SHADES, PROBS, _FACTOR, "w as (select shade_id, product_id, round(p*ff, 12) as w from ff where p >= 0.55)", "k as (select *, row_number() over (order by w desc, product_id, shade_id) as up, row_number() over (order by w, product_id, shade_id) as dn from w)",
    select="select 'top' as side, up as rank, shade_id, round(w, 6) as weighted from k where up <= 10 union all select 'worst', dn, shade_id, round(w, 6) from k where dn <= 5"))
def fam6_qa(spark, sf_dir):
    rows = fixtures.naming_long(fixtures.shades(spark, sf_dir)).where("label = 'brown'").withColumn("query_id", F.lit("q"))
    prefs = spark.createDataFrame([("q", "brown", "brightness", "lower", "strong")], "query_id string, label string, axis string, direction string, strength string")
    got = tables.stored(scoring.family_factor(rows, scoring.family_specs(prefs), calibration.label_distributions(spark)), "factors")
    return scoring.family_qa(got, "query_id").select("side", "rank", "shade_id", F.round("weighted", 6).alias("weighted"))


@query(with_(SHADES, _CONS, *_SCORED[:2], select="""select query_id, shade_id, ord, dim || op || level as name, round(weight*greatest(0, case when op = '<=' then v - thr else thr - v end)/scale, 6) as penalty,
  round(weight*tanh(case when op = '>=' then v/scale - thr/scale else thr/scale - v/scale end), 6) as tilt, round(v, 6) as value from val join (select query_id, ord, thr, scale from thr) t using (query_id, ord)"""))  # fmt: skip
def sco7_breakdown(spark, sf_dir):
    catalogue = _catalogue(spark, sf_dir)
    pool = catalogue.crossJoin(F.broadcast(_blobs(spark).select("query_id")))
    resolved = constraints.thresholds(catalogue, constraints.parse_constraints(_blobs(spark)), calibration.calibration(spark), shared=True)
    got = constraints.apply_constraints(pool, resolved, shared=True).select("query_id", "shade_id", F.explode("breakdown").alias("b"))
    return got.select("query_id", "shade_id", F.col("b.ord").alias("ord"), F.concat("b.dim", "b.op", "b.suffix").alias("name"), *(F.round(f"b.{c}", 6).alias(c) for c in ("penalty", "tilt", "value")))


@query(with_(SHADES, _PROTO, select=f"""select query_id, shade_id, round(-({abs(PREFERENCE_WEIGHTS['L'])!r}*abs(L_lab - l0)/{SCALE_IQR['L_lab']!r} + {abs(PREFERENCE_WEIGHTS['C'])!r}*abs(C_lab - sqrt(a0*a0 + b0*b0))/{SCALE_IQR['C_lab']!r}
  + {abs(PREFERENCE_WEIGHTS['H'])!r}*abs((((H_lab_deg - degrees(atan2(round(b0, 10), round(a0, 10))) + 180) % 360 + 360) % 360) - 180)/180), 6) as preference from shades, proto where r is not null"""))  # fmt: skip
def sco10_preference(spark, sf_dir):
    df = _catalogue(spark, sf_dir)
    return df.crossJoin(F.broadcast(_prototypes(df))).select("query_id", "shade_id", F.round(scoring.preference_score(), 6).alias("preference"))


_TYPICAL = (
    SHADES, _PROTO, "s as (select query_id, shade_id, product_id, L_lab, a_lab, b_lab, -C_lab/10 as score, sqrt(power(L_lab-l0,2)+power(a_lab-a0,2)+power(b_lab-b0,2)) as de from shades, proto where r is not null and cluster_id = query_id)",
    "n as (select *, row_number() over (partition by query_id order by de, product_id, shade_id) as k from s)", "m as (select query_id, median(L_lab) as ml, median(a_lab) as ma, median(b_lab) as mb from n where k <= 200 group by query_id having count(*) >= 30)",
)


@query(with_(*_TYPICAL, select="select s.query_id, shade_id, round(score - coalesce(2.5*sqrt(power(L_lab-ml,2)+power(a_lab-ma,2)+power(b_lab-mb,2)), 0), 6) as score_typical from s left join m using (query_id)"))
def sco16_typical(spark, sf_dir):
    df = _catalogue(spark, sf_dir)
    j = df.join(_prototypes(df), F.col("cluster_id") == F.col("query_id"))
    j = j.withColumns({"score": -F.col("C_lab") / 10, "deltaE": F.sqrt(sum((F.col(f"{c}_lab") - F.col(f"anchor_{c}")) * (F.col(f"{c}_lab") - F.col(f"anchor_{c}")) for c in "Lab"))})
    return scoring.typical_rerank(tables.stored(j.select("query_id", "product_id", "shade_id", "L_lab", "a_lab", "b_lab", "score", "deltaE"), "typical")).select("query_id", "shade_id", F.round("score_typical", 6).alias("score_typical"))


@query(with_(SHADES, "k as (select *, row_number() over (partition by cluster_id order by C_lab desc, product_id, shade_id) as rank from shades where r is not null)",
    select="select k.cluster_id, rank, k.product_id, k.shade_id, raw.brand_name as brand_name__inv, raw.shade_name as shade_name__inv, raw.url as url__inv from k left join raw on raw.product_id = k.product_id and raw.shade_id = k.shade_id where rank <= 20"))
def jon7_inventory(spark, sf_dir):
    top = relational.top_per(_catalogue(spark, sf_dir, "cluster_id", "product_id", "shade_id", "C_lab"), ["cluster_id"], [F.desc("C_lab"), "product_id", "shade_id"], 20).select("cluster_id", "rank", "product_id", "shade_id")
    inventory = fixtures.raw_items(spark, sf_dir).select("product_id", "shade_id", "brand_name", "shade_name", "url")
    return relational.with_inventory(top, inventory.unionByName(inventory.where("shade_id like '%7'")), ["product_id", "shade_id"])


@query(with_(SHADES, "n as (select *, count(*) over (partition by cluster_id) as n, row_number() over (partition by cluster_id order by L_lab desc, shade_id) as up, row_number() over (partition by cluster_id order by L_lab, shade_id desc) as dn from shades where r is not null)",
    select="select n.cluster_id, n.shade_id, case when up <= greatest(round_even(n*0.15, 0), 1) then 1 else 0 end as label, round(f.C_lab, 6) as C_lab, round(f.warmth, 6) as warmth from n join shades f on f.shade_id = n.shade_id and f.product_id = n.product_id where cast(n.shade_id as bigint) % 3 <> 0 and n >= 50 and (up <= greatest(round_even(n*0.15, 0), 1) or dn <= greatest(round_even(n*0.15, 0), 1))"))
def mlp3_features(spark, sf_dir):
    """Weak labels joined with the features of the rows that have them (two of three)."""
    df = _catalogue(spark, sf_dir, "cluster_id", "product_id", "shade_id", "L_lab", "C_lab", "warmth")
    labels = relational.top_fractions(df.select("cluster_id", "product_id", "shade_id", "L_lab"), "cluster_id", "L_lab", "shade_id")
    features = df.where(F.col("shade_id").cast("long") % 3 != 0).select("product_id", "shade_id", "C_lab", "warmth")
    return relational.attach_features(labels.select("cluster_id", "product_id", "shade_id", "label"), features, ["C_lab", "warmth"]).select("cluster_id", "shade_id", "label", *rounded("C_lab", "warmth"))


@query("select count(*) as n, round(avg(case when n = 1 then 1.0 else 0.0 end), 9) as share from (select p_name || p_type || p_size as x, count(*) as n from part group by 1)")
def win13_unique(spark, sf_dir):
    return relational.unique_share(fixtures.table(spark, sf_dir, "part").select(F.concat("p_name", "p_type", F.col("p_size").cast("string")).alias("x")), "x").withColumn("share", F.round("share", 9))


@query(with_(SHADES, select="select shade_id, key from (select shade_id, unnest(list_distinct(string_split(lower(product_name), ' '))) as key from shades) join (select distinct lower(string_split(p_name, ' ')[1]) as key from part) using (key) where key not in (select lower(string_split(p_name, ' ')[1]) from part where p_size % 10 = 3 and p_partkey < 40)"))
def jon15_unblocked(spark, sf_dir):
    p = fixtures.table(spark, sf_dir, "part")
    word = F.lower(F.split("p_name", " ")[0])
    found = relational.word_matches(fixtures.raw_items(spark, sf_dir), p.select(word.alias("key")), "product_name").select("shade_id", "key")
    return relational.without_keys(found, p.where("p_size % 10 = 3 and p_partkey < 40").select(word.alias("key")), "key")


@query(with_(
    SHADES, ANCHORS, _ELIGIBLE, f"c as (select query_id, count(*) filter (de00 <= base) as n, min(de00) as d, any_value(base) as base, count(*) filter (de00 <= base and {_GUARD}) as size from pairs group by query_id)",
    select="select query_id, query_id in ('brown', 'coral', 'pink', 'red', 'gray', 'blue') and (n < 20 or d > base or size < 20) as gate from c"))
def pol9_gate(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    sizes = pools.hard_pool(pairs).groupBy("query_id").agg(F.count("*").alias("size"))
    known = fixtures.anchors(spark).where(F.col("query_id").isin("brown", "coral", "pink", "red", "gray", "blue"))
    return pools.naming_gate(pools.coverage(pairs).join(fixtures.anchors(spark).select("query_id", "anchor_C"), "query_id"), sizes, known)


@query(with_(SHADES, select="select shade_id, product_id from raw order by product_id, shade_id limit 1200"))
def pol11_no_colour(spark, sf_dir):
    return pools.no_colour_pool(fixtures.raw_items(spark, sf_dir), 1200).select("shade_id", "product_id")


_COS = "list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform({b}, lambda x: x::double))"


@query(f"""with i as (select embedding as e from embeddings order by vec_id limit 1), x as (select embedding as e from embeddings order by vec_id desc limit 1),
n as (select a.vec_id, a.embedding as inc, b.embedding as exc from embeddings a join embeddings b on b.vec_id = case when a.vec_id % 2 = 0 then a.vec_id + 1 else a.vec_id - 1 end),
s as (select vec_id, {_COS.format(b='i.e').replace('embedding', 'inc')} as il, {_COS.format(b='x.e').replace('embedding', 'inc')} as id, {_COS.format(b='i.e').replace('embedding', 'exc')} as el, {_COS.format(b='x.e').replace('embedding', 'exc')} as ed from n a, i, x),
m as (select vec_id, greatest(il, id, el, ed) as best, (il - id) - (ed - el) as score from s)
select vec_id, case when best < 0.3 or abs(score) < 0.1 then 'UNKNOWN' when score > 0 then 'LIKE' else 'DISLIKE' end as polarity from m""")
def txt8_vector_polarity(spark, sf_dir):
    """Each vector as the text that includes a mention, its neighbour as the one that excludes it."""
    e = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("inc"))
    other = e.select(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id") - 1).alias("vec_id"), F.col("inc").alias("exc"))
    poles = e.agg(F.min_by("inc", "vec_id").alias("like"), F.max_by("inc", "vec_id").alias("dislike"))
    return preference.vector_polarity(e.join(other, "vec_id").crossJoin(F.broadcast(poles)), "inc", "exc", "like", "dislike").select("vec_id", "polarity")


@query("""with c as (select l_orderkey as k, l_linenumber as n, (['strict', 'LEXICON', 'family', 'none'])[l_partkey % 4 + 1] as gate, l_quantity / 50 as conf, (l_discount * 2)::double as margin, l_suppkey % 2 = 0 as neg, l_partkey % 3 = 0 as cmp, (['too', 'more', null])[l_suppkey % 3 + 1] as deg, l_tax * 12 as inten from lineitem)
select k, n, case when upper(gate) in ('STRICT', 'LEXICON') and conf >= 0.5 and margin >= 0.1 then 'high' when upper(gate) in ('STRICT', 'LEXICON') or (conf >= 0.45 and margin >= 0.05) then 'med' else 'low' end as quality,
  case when neg or cmp or deg is not null then 'strong' when 0.35 * least(greatest(inten, 0), 1e9) >= 0.35 then 'med' else 'weak' end as strength from c""")
def txt14_strength(spark, sf_dir):
    li = fixtures.table(spark, sf_dir, "lineitem")
    gate = F.element_at(F.array(*map(F.lit, ("strict", "LEXICON", "family", "none"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    degree = F.when(F.col("l_suppkey") % 3 == 0, "too").when(F.col("l_suppkey") % 3 == 1, "more")
    negated = F.col("l_suppkey") % 2 == 0
    score = preference.degree_score(negated, F.col("l_partkey") % 3 == 0, degree, F.round(F.col("l_tax") * 12, 9))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), preference.quality_label(gate, F.col("l_quantity") / 50, (F.col("l_discount") * 2).cast("double")).alias("quality"), preference.strength_of(score, negated).alias("strength"))


@query(with_(
    *_INDEX, "ax as (select unnest(['dark', 'cold', 'light', 'blue']) as word)",
    "qs as (select p_partkey as query_id, lower(w) || (['', 's', 'ish', ' rod'])[p_partkey % 4 + 1] as q from (select p_partkey, string_split(p_name, ' ')[p_partkey % 2 + 1] as w from part))",
    "q2 as (select * from qs where q not in ('the', 'small') and not (q in (select word from ax) and q not in (select key from ix where least(n_hex, n_sources) >= 3 or n_phrase >= 5 or (n_sources >= 3 and n_hex >= 2))))",
    "e as (select query_id, q as alias, 1 as stage, 100.0 as score from q2 where q in (select key from ix))",
    "v as (select query_id, arg_min(v, struct_pack(n := length(v), v := v)) as alias, 2 as stage, 99.0 as score from (select query_id, q, substr(q, 1, length(q) - 3) as v from q2 where length(q) >= 5 and ends_with(q, 'ish') union all select query_id, q, substr(q, 1, length(q) - 1) from q2 where length(q) >= 5 and ends_with(q, 's') and not regexp_matches(q, '(ss|us|is)$') union all select query_id, q, substr(q, 1, length(q) - 1) from q2 where length(q) >= 4 and ends_with(q, 'y')) where not contains(q, ' ') and v in (select key from ix) and query_id not in (select query_id from e) group by query_id)",
    select="select query_id, alias, cast(stage as int) as stage, cast(score as double) as score from e union all select * from v"))
def txt4_ladder(spark, sf_dir):
    """Exact and variant stages on a vocabulary whose words are too short or too far apart for fuzzy ones (tests hold those)."""
    p, k = fixtures.table(spark, sf_dir, "part"), F.col("p_partkey")
    word = F.lower(F.element_at(F.split("p_name", " "), (k % 2 + 1).cast("int")))
    tail = F.element_at(F.array(*map(F.lit, ("", "s", "ish", " rod"))), (k % 4 + 1).cast("int"))
    index = tables.stored(assets.key_index(tables.stored(_named(spark, sf_dir), "names")), "index").withColumn("role", F.lit(None).cast("string"))
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "word string")
    return assets.resolve(p.select(k.alias("query_id"), F.concat(word, tail).alias("text")), index, words("dark", "cold", "light", "blue"), words("the", "small"), cutoff=97.0, single_cutoff=97.0)


def _naive_sql(wish: str) -> str:
    rules = (("deep", "(100 - L_lab)*0.01"), ("bright", "L_lab*0.01"), ("soft", "-C_lab*0.01"), ("nude", "-abs(H_lab_deg - 30)*0.001"))
    return " + ".join(["0", *(x for w, x in rules if w in wish)])


@query(with_(SHADES, "s as (" + " union all ".join(f"select '{q}' as query_id, shade_id, L_lab, C_lab, H_lab_deg, round({_naive_sql(t)}, 12) as s from shades where r is not null" for q, t in learning.TEXTS) + ")",
    "k as (select *, row_number() over (partition by query_id order by s desc, shade_id) as up, row_number() over (partition by query_id order by s, shade_id desc) as dn from s)",
    "j as (select a.query_id, a.shade_id as p, b.shade_id as n, a.L_lab - b.L_lab as dl, a.C_lab - b.C_lab as dc, (((a.H_lab_deg - b.H_lab_deg + 180) % 360 + 360) % 360) - 180 as dh from k a join k b using (query_id) where a.up <= 10 and b.dn <= 10)",
    select="select query_id, p as item_pos_id, n as item_neg_id, round(dl, 6) as delta_L, round(dc, 6) as delta_C, round(dh, 6) as delta_H, 1 as label from j union all select query_id, n, p, round(-dl, 6), round(-dc, 6), round(-dh, 6), 0 from j"))
def mlp5_pairwise(spark, sf_dir):
    df = _catalogue(spark, sf_dir, "shade_id", "L_lab", "C_lab", "H_lab_deg")
    return learning.pairwise(df).select("query_id", "item_pos_id", "item_neg_id", *rounded("delta_L", "delta_C", "delta_H"), "label")


@query(with_(
    SHADES, "n as (select *, count(*) over (partition by cluster_id) as n, row_number() over (partition by cluster_id order by C_lab desc, shade_id) as up, row_number() over (partition by cluster_id order by C_lab, shade_id desc) as dn from shades where r is not null)",
    "w as (select cluster_id, product_id, shade_id, case when up <= greatest(round_even(n*0.15, 0), 1) then 1 else 0 end as label from n where n >= 50 and (up <= greatest(round_even(n*0.15, 0), 1) or dn <= greatest(round_even(n*0.15, 0), 1)))",
    "k as (select *, count(*) over (partition by label) as n, row_number() over (partition by label order by md5(product_id || '|' || shade_id || '|7'), product_id, shade_id) as k from w)",
    select="select cluster_id, product_id, shade_id, label, case when k <= round(n*0.7) then 'train' when k <= round(n*(0.7+0.15)) then 'valid' else 'test' end as split from k"))
def mlp4_split(spark, sf_dir):
    df = _catalogue(spark, sf_dir)
    labels = relational.top_fractions(df, "cluster_id", "C_lab", "shade_id")
    return learning.stratified_split(labels.select("cluster_id", "product_id", "shade_id", "label"), ["product_id", "shade_id"])


@query()
def mlp6_weights(spark, sf_dir):
    """The preference weights that the naive rule's pairs teach."""
    pairs = tables.stored(learning.pairwise(_catalogue(spark, sf_dir, "shade_id", "L_lab", "C_lab", "H_lab_deg")), "pairs")
    return spark.createDataFrame(list(zip("LCH", (round(float(w), 4) for w in learning.preference_weights(pairs).coefficients.toArray()))), "dim string, weight double")


@query()
def mlp10_report(spark, sf_dir):
    """The ranker's figures on train, valid and test rows."""
    df = _catalogue(spark, sf_dir)
    labels = relational.top_fractions(df, "cluster_id", "C_lab", "shade_id")
    rows = tables.stored(learning.stratified_split(labels, ["product_id", "shade_id"]), "split")
    report = learning.evaluation_report(learning.linear_ranker(rows.where("split = 'train'"), iterations=100), rows)
    return report.select("split", "n", *(F.round(c, 3).alias(c) for c in ("accuracy", "positive_rate", "auc", "ap")))


@query()
def ast9_namer(spark, sf_dir):
    """The most likely name of every chip, by a namer fitted on the names that chips are given by the fixed model where it is sure."""
    chips = _catalogue(spark, sf_dir, "shade_id", "L_lab", "a_lab", "b_lab")
    probs = fixtures.naming(chips)
    label = F.element_at(F.array(*map(F.lit, fixtures.LABELS)), F.array_position(F.array(*(F.col(f"p_{n}") for n in fixtures.LABELS)), F.greatest(*(F.col(f"p_{n}") for n in fixtures.LABELS))).cast("int"))
    train = tables.stored(probs.where(F.greatest(*(F.col(f"p_{n}") for n in fixtures.LABELS)) >= 0.9).select("L_lab", "a_lab", "b_lab", label.alias("label")), "named")
    p = learning.name_probabilities(learning.colour_namer(train), chips)
    names = [c for c in p.columns if c.startswith("p_")]
    best = F.array_max(F.array(*(F.struct(F.col(c).alias("p"), F.lit(c[2:]).alias("name")) for c in names)))
    return p.select("shade_id", best["name"].alias("name"), F.round(best["p"], 3).alias("p"))



@query(with_(SHADES, "bad as (select shade_id, case cast(shade_id as bigint) % 7 when 0 then 'zz' when 1 then upper(chip_hex) else chip_hex end as hex, case when cast(shade_id as bigint) % 11 = 0 then null else L_lab end as L_lab from shades)",
    select="select shade_id, hex from bad where regexp_matches(hex, '^#[0-9a-fA-F]{6}$') and L_lab is not null"))
def flt6_valid(spark, sf_dir):
    k = F.col("shade_id").cast("long")
    df = fixtures.shades(spark, sf_dir).select("shade_id", F.when(k % 7 == 0, "zz").when(k % 7 == 1, F.upper("chip_hex")).otherwise(F.col("chip_hex")).alias("hex"), F.when(k % 11 == 0, float("nan")).when(k % 11 != 0, F.col("L_lab")).alias("L_lab"), "C_lab", "H_lab_deg")
    return relational.valid_colour(tables.stored(df, "hexes"), "hex").select("shade_id", "hex")


@query(with_(SHADES, "proto as (select cluster_id, avg(L_lab) as l0, avg(a_lab) as a0, avg(b_lab) as b0 from shades where r is not null and cluster_id < 5 group by cluster_id)", "pm as (select cluster_id, avg(L_lab) as lm, avg(a_lab) as am, avg(b_lab) as bm from shades where r is not null and L_lab > 40 group by cluster_id)",
    "q as (select c_custkey as query_id, cast(c_custkey % 8 as int) as cluster_id, case when c_custkey % 3 = 0 then (c_nationkey + 30)::double end as al, case when c_custkey % 3 = 0 then 10.0::double end as aa, case when c_custkey % 6 = 0 then 5.0::double end as ab from customer)",
    select="""select query_id, case when ab is not null then 'anchor' when l0 is not null then 'prototype' when lm is not null then 'pool' end as centre, round(case when ab is not null then al when l0 is not null then l0 else lm end, 6) as anchor_L,
  round(case when ab is not null then ab when l0 is not null then b0 else bm end, 6) as anchor_b from q left join proto using (cluster_id) left join pm using (cluster_id)"""))  # fmt: skip
def sco9_centres(spark, sf_dir):
    df = _catalogue(spark, sf_dir, "cluster_id", "L_lab", "a_lab", "b_lab")
    protos = df.where("cluster_id < 5").groupBy("cluster_id").agg(*(F.avg(c).alias(c) for c in ("L_lab", "a_lab", "b_lab")))
    k = F.col("c_custkey")
    queries = fixtures.table(spark, sf_dir, "customer").select(k.alias("query_id"), (k % 8).cast("int").alias("cluster_id"), F.when(k % 3 == 0, (F.col("c_nationkey") + 30).cast("double")).alias("anchor_L"), F.when(k % 3 == 0, F.lit(10.0)).alias("anchor_a"), F.when(k % 6 == 0, F.lit(5.0)).alias("anchor_b"))
    means = df.where("L_lab > 40").groupBy("cluster_id").agg(*(F.avg(c).alias(c) for c in ("L_lab", "a_lab", "b_lab")))  # a query's pool: its cluster's light shades
    got = scoring.centres(queries, protos, queries.select("query_id", "cluster_id").join(means, "cluster_id"))
    return got.select("query_id", "centre", *rounded("anchor_L", "anchor_b"))


@query(with_(SHADES, "n as (select *, count(*) over (partition by cluster_id) as n, row_number() over (partition by cluster_id order by C_lab desc, shade_id) as up, row_number() over (partition by cluster_id order by C_lab, shade_id desc) as dn from shades where r is not null)",
    select="select 0 as part, shade_id, round(C_lab, 6) as C_lab, cast(null as double) as L_lab from n where n >= 50 and up <= greatest(round_even(n*0.15, 0), 1) union all select 1, shade_id, null, round(L_lab, 6) from n where n >= 50 and up > greatest(round_even(n*0.15, 0), 1) and dn <= greatest(round_even(n*0.15, 0), 1)"))
def set1_concat(spark, sf_dir):
    df = _catalogue(spark, sf_dir, "cluster_id", "product_id", "shade_id", "L_lab", "C_lab")
    weak = tables.stored(relational.top_fractions(df, "cluster_id", "C_lab", "shade_id"), "weak")
    return relational.concatenated([weak.where("label = 1").select("shade_id", F.round("C_lab", 6).alias("C_lab")), weak.where("label = 0").select("shade_id", F.round("L_lab", 6).alias("L_lab"))], "part")


_AXIS_SIMS = """keys as (select label, arg_min(embedding, vec_id) as embedding from embeddings group by label),
s as (select b.vec_id, 'axis' || (a.label % 5) as axis, max(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double))) as sim from keys a, embeddings b group by all)"""


def _axis_sims(spark, sf_dir):
    """Similarities of every vector to five axes, each described by two label keys."""
    e = fixtures.table(spark, sf_dir, "embeddings")
    d = fixtures.label_keys(e).select(F.concat(F.lit("axis"), (F.col("label") % 5).cast("string")).alias("axis"), "key")
    return e.select("vec_id", "embedding"), e.crossJoin(F.broadcast(d)).groupBy("vec_id", "axis").agg(F.max(stats.cosine(F.col("embedding"), F.col("key"))).alias("score"))


_PROBES = "pr as (select 'axis' || i || '|axis' || (i + 1) as pair, 'axis' || (i + j) as axis, (select embedding from embeddings where vec_id = (select min(vec_id) from embeddings) + 3*i + j) as key from range(0, 4) r(i), range(0, 2) q(j))"


@query(with_(_AXIS_SIMS, _PROBES,
    "t as (select vec_id, list({'s': sim, 'a': axis} order by sim desc, axis desc) as l from s group by vec_id)", "c as (select vec_id, l[1].a as a1, l[1].s as s1, l[2].a as a2, round(l[1].s - l[2].s, 9) as gap from t)",
    "q as (select c.vec_id, pr.axis, list_cosine_similarity(list_transform(e.embedding, lambda x: x::double), list_transform(pr.key, lambda x: x::double)) as sim from c join embeddings e using (vec_id) join pr on pr.pair = least(a1, a2) || '|' || greatest(a1, a2) where s1 >= 0.1 and gap < 0.08)",
    "o as (select vec_id, case when round(max(sim) - min(sim), 9) >= 0.02 then arg_max(axis, sim) end as told from q group by vec_id)",
    select="select vec_id, coalesce(told, case when s1 >= 0.1 and gap >= 0.08 then a1 end) as axis, told is not null as probed from c left join o using (vec_id)"))
def txt10_ties(spark, sf_dir):
    vectors, sims = _axis_sims(spark, sf_dir)
    listed = sims.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct(F.col("score").alias("sim"), "axis")), asc=False).alias("s"))
    low = vectors.agg(F.min("vec_id").alias("_low"))
    probe = vectors.crossJoin(F.broadcast(low)).select((F.col("vec_id") - F.col("_low")).alias("k"), F.col("embedding").alias("key"))
    asked = spark.createDataFrame([(3 * i + j, f"axis{i}|axis{i + 1}", f"axis{i + j}") for i in range(4) for j in range(2)], "k long, pair string, axis string")
    return preference.break_ties(listed, vectors, asked.join(probe, "k").drop("k"), least=0.1)


@query(with_(_AXIS_SIMS,
    "k as (select *, row_number() over (partition by vec_id order by round(sim, 9) desc, axis) as k from s)",
    "w as (select a.vec_id as label, b.vec_id as variant, list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) as weight from embeddings a join embeddings b on a.label = b.label and b.vec_id between a.vec_id - 40 and a.vec_id + 40)",
    "v as (select label, axis, sum(weight*sim)/sum(weight) as score from w join k on k.vec_id = w.variant where weight > 0 and k <= 3 group by all)",
    "o1 as (select vec_id as label, list({'s': round(sim, 9), 'a': axis} order by round(sim, 9) desc, axis) as l from s group by vec_id)", "v1 as (select label, list({'s': round(score, 9), 'a': axis} order by round(score, 9) desc, axis) as l from v group by label)",
    "j as (select o1.label, o1.l[1].a as oa, o1.l[1].s >= 0.35 as near, round(o1.l[1].s - o1.l[2].s, 9) >= 0.08 as clear, v1.l[1].a as va, coalesce(v1.l[1].s >= 0.35 and round(v1.l[1].s - coalesce(v1.l[2].s, 0), 9) >= 0.08, false) as vsure from o1 left join v1 using (label))",
    select="select label, case when near and clear then oa when vsure then va when near then oa end as axis, case when near and clear then 'classifier' when vsure then 'vote' when near then 'raw' end as source from j"))
def txt11_choice(spark, sf_dir):
    vectors, sims = _axis_sims(spark, sf_dir)
    e = fixtures.table(spark, sf_dir, "embeddings")
    near = relational.neighbours(e.select("label", "vec_id", "embedding"), e.select("label", F.col("vec_id").alias("variant"), F.col("embedding").alias("_e")), ["label"], "vec_id", "variant", 40)
    variants = near.select(F.col("vec_id").alias("label"), "variant", stats.cosine(F.col("embedding"), F.col("_e")).alias("weight"))
    own = tables.stored(sims.withColumnRenamed("vec_id", "label"), "axis-sims")
    return preference.choose_axes(own, preference.vote_axes(own, variants))
