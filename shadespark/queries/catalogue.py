"""Filters, joins, aggregations, ranks and sets over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color, text
from ..operators import aggregates, checks, relational
from ..sources import fixtures, tables
from .base import ANCHORS, PROBS, SHADES, query, rounded, with_

BAD = "regexp_matches(lower(product_name || ' ' || shade_name), '(^|[^a-z0-9é])(clear|universal|recharge|refill|echargeable|rechargeable|écrin|ecrin|étui|case|cap|marbre|strass)($|[^a-z0-9é])')"


def shades(spark, sf_dir):
    return fixtures.shades(spark, sf_dir)


@query(with_(SHADES, select=f"select shade_id, product_name from shades where not {BAD}"))
def flt1_eligible(spark, sf_dir):
    return relational.eligible(fixtures.raw_items(spark, sf_dir)).select("shade_id", "product_name")


@query(with_(SHADES, select="select shade_id, round(H_lab_deg, 5) as hue from shades where r is not null and abs((((H_lab_deg - 20 + 180) % 360 + 360) % 360) - 180) <= 28"))
def flt5_hue_band(spark, sf_dir):
    df = tables.stored(relational.with_colour(shades(spark, sf_dir)).select("shade_id", "H_lab_deg"), "hue")
    return df.where(relational.in_hue_band(F.col("H_lab_deg"), F.lit(20.0), F.lit(28.0))).select("shade_id", F.round("H_lab_deg", 5).alias("hue"))


@query(with_(SHADES, select="select s.shade_id, s.shade_name from shades s where not exists (select 1 from raw d where d.shade_name = s.shade_name and cast(d.shade_id as bigint) % 50 = 0)"))
def flt8_deny(spark, sf_dir):
    items = fixtures.raw_items(spark, sf_dir)
    denied = items.where(F.col("shade_id").cast("long") % 50 == 0)
    return relational.without_keys(items, denied, "shade_name").select("shade_id", "shade_name")


@query(
    with_(
        SHADES,
        select="""select shade_id, C_lab > c90 as vivid, L_lab < l10 or L_lab > l90 as extreme from shades,
  (select quantile_cont(C_lab, 0.9) as c90, quantile_cont(L_lab, 0.1) as l10, quantile_cont(L_lab, 0.9) as l90 from shades) where r is not null""",
    )
)
def flt11_tails(spark, sf_dir):
    df = tables.stored(shades(spark, sf_dir).where("r is not null").select("shade_id", "L_lab", "C_lab"), "tails")
    return df.crossJoin(F.broadcast(aggregates.tails(df))).select("shade_id", (F.col("C_lab") > F.col("c90")).alias("vivid"), ((F.col("L_lab") < F.col("l10")) | (F.col("L_lab") > F.col("l90"))).alias("extreme"))


@query(
    with_(
        SHADES,
        select="""select row_number() over (order by cast(shade_id as bigint)) as ord, case when cast(shade_id as bigint) % 5 = 0 then 'dim' when cast(shade_id as bigint) % 7 = 0 then 'op' when cast(shade_id as bigint) % 11 = 0 then 'level' else 'weight' end as reason
  from shades where cast(shade_id as bigint) % 5 = 0 or cast(shade_id as bigint) % 7 = 0 or cast(shade_id as bigint) % 11 = 0 or cast(shade_id as bigint) % 13 = 0""",
    )
)
def chk2_constraints(spark, sf_dir):
    k = F.col("k")
    cons = fixtures.raw_items(spark, sf_dir).select(F.col("shade_id").cast("long").alias("k")).select(
        "k", F.when(k % 5 == 0, "size").otherwise("L_lab").alias("dim"), F.when(k % 7 == 0, "<").otherwise("<=").alias("op"), F.when(k % 11 == 0, "huge").otherwise("low").alias("level"), F.lit(None).cast("double").alias("cutpoint"), F.when(k % 13 == 0, -1.0).otherwise(1.0).alias("weight")
    )
    bad = tables.stored(checks.bad_constraints(cons).select("k", "reason").withColumn("_all", F.lit(1)), "bad")
    binned = aggregates.ranged(bad, ["_all"], "k")
    place = F.row_number().over(Window.partitionBy("_bin").orderBy("k"))
    return binned.join(aggregates.offsets(binned, ["_all"], F.count("*")).drop("_all"), "_bin").select((place + F.col("_before")).cast("long").alias("ord"), "reason")


@query(with_(SHADES, select="select count(distinct product_id) as products, count(distinct product_id || '|' || shade_id) as shades, count(distinct cluster_id) as families from shades"))
def chk5_headline(spark, sf_dir):
    return checks.headline(fixtures.raw_items(spark, sf_dir), "cluster_id")


@query(
    with_(
        SHADES, PROBS,
        select="select shade_id, chip_hex, round(max(p) filter (label = 'red'), 6) as p_red, round(max(p) filter (label = 'taupe'), 6) as p_taupe from probs group by all union all select shade_id, chip_hex, null, null from shades where r is null",
    )
)
def jon1_naming(spark, sf_dir):
    df = shades(spark, sf_dir)
    probs = tables.naming_probabilities(fixtures.naming(df.where("r is not null")).withColumn("chip_hex", F.upper("chip_hex")))
    return df.select("shade_id", "chip_hex").join(probs, "chip_hex", "left").select("shade_id", "chip_hex", *rounded("p_red", "p_taupe"))


@query(with_(SHADES, select="select s.shade_id, round(f.L_lab, 6) as L_lab, f.chip_hex from shades s left join (select * from shades where cluster_id < 4) f using (product_id, shade_id)"))
def jon2_best_key(spark, sf_dir):
    df = shades(spark, sf_dir)
    right = df.where("cluster_id < 4")
    return relational.left_on_best_key(df.select("product_id", "shade_id"), right, ["L_lab", "chip_hex"]).select("shade_id", F.round("L_lab", 6).alias("L_lab"), "chip_hex")


@query(
    with_(
        SHADES, ANCHORS,
        select="""select shade_id, arg_min(query_id, {'d': round(power(L_lab-anchor_L,2)+power(a_lab-anchor_a,2)+power(b_lab-anchor_b,2), 6), 'q': query_id}) as nearest from shades, anchors where r is not null group by shade_id""",
    )
)
def jon10_nearest(spark, sf_dir):
    pivots = fixtures.anchors(spark).select("query_id", F.col("anchor_L").alias("L_lab"), F.col("anchor_a").alias("a_lab"), F.col("anchor_b").alias("b_lab"))
    return relational.nearest(shades(spark, sf_dir).where("r is not null"), pivots, ["L_lab", "a_lab", "b_lab"], "query_id").select("shade_id", "nearest")


@query(with_(SHADES, select="select shade_id, key from (select shade_id, unnest(list_distinct(string_split(lower(product_name), ' '))) as key from shades) join (select distinct lower(p_name.string_split(' ')[1]) as key from part) using (key)"))
def jon12_words(spark, sf_dir):
    keys = fixtures.table(spark, sf_dir, "part").select(F.lower(F.split("p_name", " ")[0]).alias("key"))
    return relational.word_matches(fixtures.raw_items(spark, sf_dir), keys, "product_name").select("shade_id", "key")


@query("""with k as (select distinct lower(p_name) as key from part), b as (select distinct lower(string_split(p_name, ' ')[1]) as base from part)
select base, key from (select key, unnest(list_distinct(string_split(key, ' '))) as base from k where len(string_split(key, ' ')) > 1) join b using (base)""")
def jon13_containing(spark, sf_dir):
    part = fixtures.table(spark, sf_dir, "part")
    return relational.containing_keys(part.select(F.lower(F.split("p_name", " ")[0]).alias("key")), part.select(F.lower("p_name").alias("key")).distinct())


@query(
    with_(
        SHADES,
        select="""select l.shade_id, coalesce(a.v, b.v, c.v) as url, case when a.v is not null then 1 when b.v is not null then 2 when c.v is not null then 3 end as stage
from raw l left join (select product_id, shade_id, min(url) as v from raw where cluster_id = 0 group by all) a using (product_id, shade_id)
left join (select brand_name, shade_name, min(url) as v from raw where cluster_id < 3 group by all) b using (brand_name, shade_name)
left join (select shade_name, min(url) as v from raw where cluster_id < 3 group by shade_name having count(*) = 1) c using (shade_name)""".replace("from raw where cluster_id = 0", "from raw where cluster_id < 3"),
    )
)
def jon16_cascade(spark, sf_dir):
    items = fixtures.raw_items(spark, sf_dir)
    return relational.cascade_match(items.drop("url"), items.where("cluster_id < 3"), [["product_id", "shade_id"], ["brand_name", "shade_name"], ["shade_name"]], "url").select("shade_id", "url", "stage")


@query(with_(SHADES, select="select label, axis, round(q[1], 6) as q05, round(q[4], 6) as q50, round(q[7], 6) as q95, n from (select label, 'L_lab' as axis, quantile_cont(L_lab, [0.05,0.1,0.25,0.5,0.75,0.9,0.95]) as q, count(*) as n from (select *, cluster_id as label from shades where r is not null) group by label union all select label, 'C_lab', quantile_cont(C_lab, [0.05,0.1,0.25,0.5,0.75,0.9,0.95]), count(*) from (select *, cluster_id as label from shades where r is not null) group by label)"))
def agg1_quantiles(spark, sf_dir):
    df = shades(spark, sf_dir).where("r is not null").withColumnRenamed("cluster_id", "label")
    q = aggregates.quantiles(df, ["label"], ["L_lab", "C_lab"], (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))
    return q.select("label", "axis", *(F.round(F.col("q")[k], 6).alias(n) for k, n in ((0, "q05"), (3, "q50"), (6, "q95"))), "n")


@query(with_(SHADES, select="select 'L_lab' as dim, round(quantile_cont(L_lab, 0.75) - quantile_cont(L_lab, 0.25), 6) as iqr, round(stddev_pop(L_lab), 6) as std from shades union all select 'sat_eff', round(quantile_cont(sat_eff, 0.75) - quantile_cont(sat_eff, 0.25), 6), round(stddev_pop(sat_eff), 6) from shades"))
def agg2_spread(spark, sf_dir):
    return aggregates.spread(shades(spark, sf_dir), ["L_lab", "sat_eff"]).select("dim", *rounded("iqr", "std"))


@query(with_(SHADES, PROBS, select="select label, round(sum(p*L_lab)/sum(p), 6) as L_lab, round(sum(p*a_lab)/sum(p), 6) as a_lab, round(sum(p*b_lab)/sum(p), 6) as b_lab from probs group by label"))
def agg4_weighted_mean(spark, sf_dir):
    return aggregates.weighted_mean(fixtures.naming_long(shades(spark, sf_dir)), ["label"], ["L_lab", "a_lab", "b_lab"], "p").select("label", *rounded("L_lab", "a_lab", "b_lab"))


@query(with_(SHADES, PROBS, select="select label, round(min(C_lab) filter (s >= 0.9), 6) as value from (select *, sum(p) over (partition by label order by C_lab, product_id, shade_id rows unbounded preceding)/sum(p) over (partition by label) as s from probs) group by label"))
def agg5_weighted_quantile(spark, sf_dir):
    long = tables.stored(fixtures.naming_long(shades(spark, sf_dir)), "naming")
    return aggregates.weighted_quantile(long, ["label"], "C_lab", "p", 0.9).select("label", F.round("value", 6).alias("value"))


@query(
    with_(
        SHADES,
        select="""select cluster_id, arg_min(chip_hex, {'d': round(power(L_lab-ml,2)+power(a_lab-ma,2)+power(b_lab-mb,2), 9), 'k': chip_hex}) as medoid from
  (select *, avg(L_lab) over w as ml, avg(a_lab) over w as ma, avg(b_lab) over w as mb from shades where r is not null window w as (partition by cluster_id)) group by cluster_id""",
    )
)
def agg6_medoid(spark, sf_dir):
    return aggregates.lab_medoids(shades(spark, sf_dir).where("r is not null"), ["cluster_id"], "chip_hex", "chip_hex")


@query(with_(SHADES, select="select cluster_id, round((degrees(atan2(avg(sin(radians(H_lab_deg))), avg(cos(radians(H_lab_deg))))) + 360) % 360, 5) as mean_hue from shades where r is not null group by cluster_id"))
def agg8_circular(spark, sf_dir):
    return aggregates.hue_means(shades(spark, sf_dir).where("r is not null"), ["cluster_id"], "H_lab_deg").select("cluster_id", F.round("mean_hue", 5).alias("mean_hue"))


@query(with_(SHADES, select="select cluster_id, round(median(L_lab), 6) as L_lab, round(median(a_lab), 6) as a_lab, round(median(b_lab), 6) as b_lab from shades where r is not null group by cluster_id"))
def agg9_median(spark, sf_dir):
    return aggregates.median_lab(shades(spark, sf_dir).where("r is not null"), ["cluster_id"]).select("cluster_id", *rounded("L_lab", "a_lab", "b_lab"))


@query(
    with_(
        SHADES,
        select="""select cluster_id, n, round(mean_L, 6) as mean_L, round(std_L, 6) as std_L, round(mean_de, 6) as mean_de, round(p90_de, 6) as p90_de from (
  select cluster_id, count(*) as n, avg(L_lab) as mean_L, stddev_pop(L_lab) as std_L, avg(d) as mean_de, quantile_cont(d, 0.9) as p90_de from
  (select s.*, sqrt(power(s.L_lab-p.l,2)+power(s.a_lab-p.a,2)+power(s.b_lab-p.bb,2)) as d from shades s join (select cluster_id, avg(L_lab) as l, avg(a_lab) as a, avg(b_lab) as bb from shades where r is not null group by cluster_id) p using (cluster_id) where r is not null) group by cluster_id)""",
    )
)
def agg15_clusters(spark, sf_dir):
    df = tables.stored(shades(spark, sf_dir).where("r is not null").select("cluster_id", "L_lab", "a_lab", "b_lab"), "clusters")
    protos = df.groupBy("cluster_id").agg(*(F.avg(c).alias(c) for c in ("L_lab", "a_lab", "b_lab")))
    return aggregates.cluster_report(df, protos).select("cluster_id", "n", *rounded("mean_L", "std_L", "mean_de", "p90_de"))


@query("select p_brand as brand, arg_min(p_size, {'n': -n, 's': p_size}) as mode from (select p_brand, p_size, count(*) as n from part group by all) group by p_brand")
def agg19_mode(spark, sf_dir):
    return aggregates.mode_first(fixtures.table(spark, sf_dir, "part").withColumnRenamed("p_brand", "brand"), ["brand"], "p_size")


@query("select count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, round(min(x), 6) as min, round(quantile_cont(x, 0.25), 6) as q25, round(quantile_cont(x, 0.5), 6) as q50, round(quantile_cont(x, 0.75), 6) as q75, round(max(x), 6) as max from (select p_retailprice::double as x from part)")
def agg21_describe(spark, sf_dir):
    d = aggregates.describe(fixtures.table(spark, sf_dir, "part").select(F.col("p_retailprice").cast("double").alias("x")), "x")
    return d.select("n", *rounded("mean", "std", "min", "q25", "q50", "q75", "max"))


RANKED = "r as (select quality as label, n_chars/20000e0 as p from documents join labels using (doc_id))"


def ranked_binary(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(fixtures.table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") / 20000).alias("p"))


@query(with_(RANKED, select="select label, cast(p >= 0.1 as int) as pred, count(*) as n from r group by all"))
def agg24_confusion(spark, sf_dir):
    return aggregates.confusion(ranked_binary(spark, sf_dir), "label", "p", 0.1)


@query(
    with_(
        RANKED,
        "s as (select p, sum(label) as pos, count(*) as n from r group by p)",
        "c as (select *, sum(pos) over (order by p desc) as cp, sum(n) over (order by p desc) as cn from s)",
        select="select round(sum((n-pos)*(cp-pos+pos/2.0))/(sum(pos)*sum(n-pos)), 6) as auc, round(sum(pos*cp/cn)/sum(pos), 6) as ap from c",
    )
)
def agg25_auc(spark, sf_dir):
    return aggregates.auc_ap(ranked_binary(spark, sf_dir), "label", "p").select(*rounded("auc", "ap"))


@query(with_(SHADES, "n as (select *, count(*) over (partition by cluster_id) as n, row_number() over (partition by cluster_id order by L_lab desc, shade_id) as up, row_number() over (partition by cluster_id order by L_lab, shade_id desc) as down from shades where r is not null)",
    select="select cluster_id, shade_id, case when up <= greatest(round_even(n*0.15, 0), 1) then 1 else 0 end as label from n where n >= 50 and (up <= greatest(round_even(n*0.15, 0), 1) or down <= greatest(round_even(n*0.15, 0), 1))"))
def win3_weak_labels(spark, sf_dir):
    df = tables.stored(shades(spark, sf_dir).where("r is not null").select("cluster_id", "shade_id", "L_lab"), "weak")
    return relational.top_fractions(df, "cluster_id", "L_lab", "shade_id").select("cluster_id", "shade_id", "label")


@query(with_(SHADES, PROBS, "t as (select *, row_number() over (partition by shade_id order by round(p, 12) desc, label) as k from probs)", select="select shade_id, max(label) filter (k = 1) as top1, round(max(p) filter (k = 1), 6) as p1, max(label) filter (k = 2) as top2, round(max(p) filter (k = 2), 6) as p2 from t group by shade_id"))
def win6_top_labels(spark, sf_dir):
    df = fixtures.naming(shades(spark, sf_dir).where("r is not null"))
    best = F.array_sort(F.array(*(F.struct((-F.round(f"p_{n}", 12)).alias("m"), F.lit(n).alias("label"), F.col(f"p_{n}").alias("p")) for n in fixtures.LABELS)))
    return df.withColumn("b", best).select("shade_id", F.col("b")[0]["label"].alias("top1"), F.round(F.col("b")[0]["p"], 6).alias("p1"), F.col("b")[1]["label"].alias("top2"), F.round(F.col("b")[1]["p"], 6).alias("p2"))


@query(with_(SHADES, select="select url, shade_name, shade_id from (select *, row_number() over (partition by url, shade_name order by cast(shade_id as bigint) desc) as k from raw) where k = 1"))
def set3_first(spark, sf_dir):
    return relational.first_per(fixtures.raw_items(spark, sf_dir), ["url", "shade_name"], [F.desc(F.col("shade_id").cast("long"))]).select("url", "shade_name", "shade_id")


@query(with_(SHADES, "b as (select brand_name, list(shade_id order by L_lab, shade_id)[1:10] as light, list(shade_id order by C_lab, shade_id)[1:10] as dull from shades where r is not null group by brand_name)", select="select brand_name, len(list_intersect(light, dull)) as shared, light = dull as same from b"))
def set6_overlap(spark, sf_dir):
    df = tables.stored(shades(spark, sf_dir).where("r is not null").select("brand_name", "shade_id", "L_lab", "C_lab"), "overlap")
    a = relational.signature(relational.top_per(df, ["brand_name"], ["L_lab", "shade_id"], 10), "brand_name", F.col("shade_id"))
    b = relational.signature(relational.top_per(df, ["brand_name"], ["C_lab", "shade_id"], 10), "brand_name", F.col("shade_id")).withColumnRenamed("keys", "others")
    return a.join(b, "brand_name").select("brand_name", F.size(F.array_intersect("keys", "others")).cast("long").alias("shared"), (F.col("keys") == F.col("others")).alias("same"))


@query(with_(SHADES, "c as (select cluster_id, count(*) as n, row_number() over (order by count(*) desc, cluster_id) - 1 as i, count(*) over () as t from shades where r is not null group by cluster_id)", select="select cluster_id, n from c where i in (select floor(k*(t-1)/2.0) from range(0, 3) r(k))"))
def srt7_even_picks(spark, sf_dir):
    n = fixtures.raw_items(spark, sf_dir).transform(color.enrich).where("r is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return relational.even_picks(n, [F.desc("n"), "cluster_id"], 3)


_RETRIED = ", ".join(f"'{m}.{e}{q}'" for m in ("media_zoom", "media_main", "media_hero", "media_swatch", "media_full", "media_detail", "media_thumbnail") for e in ("jpg", "jpeg", "webp", "avif", "png") for q in ("?scaleWidth=900&scaleHeight=900&scaleMode=fit", ""))


@query(
    with_(
        SHADES,
        "f as (select shade_id, case when cast(shade_id as bigint) % 26 = 0 then 'https://media.example/plain/' || shade_id || '.gif?x=1' else 'https://media.example/published/B/BRAND/1/' || shade_id || '-media_thumbnail.jpg?scaleWidth=53' end as chip_url from shades where cast(shade_id as bigint) % 13 = 0)",
        f"c as (select shade_id, case when regexp_matches(chip_url, '-media_') then list_append(list_transform([{_RETRIED}], lambda x: string_split(chip_url, '-media_')[1] || '-' || x), chip_url) else [chip_url, string_split(chip_url, '?')[1]] end as urls from f)",
        select="select shade_id, cast(generate_subscripts(urls, 1) - 1 as int) as priority, unnest(urls) as candidate_url from c",
    )
)
def src9_retry(spark, sf_dir):
    chip = F.concat(F.lit("https://media.example/published/B/BRAND/1/"), "shade_id", F.lit("-media_thumbnail.jpg?scaleWidth=53"))
    url = F.when(F.col("shade_id").cast("long") % 26 == 0, F.concat(F.lit("https://media.example/plain/"), "shade_id", F.lit(".gif?x=1"))).otherwise(chip)
    log = fixtures.raw_items(spark, sf_dir).select("shade_id", url.alias("chip_url"), F.when(F.col("shade_id").cast("long") % 13 == 0, "error").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    return tables.retry_candidates(tables.route_fetch_log(log)[1])


@query("""select page_id, k - 1 as pos, link from (select page_id, unnest(links) as link, generate_subscripts(links, 1) as k from (select page_id, list_distinct_ordered as links from (select page_id, list_filter(l, lambda x, i: list_position(l, x) = i) as list_distinct_ordered from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as l from pages))))""")
def web1_links(spark, sf_dir):
    from ..sources import web

    return web.links(fixtures.table(spark, sf_dir, "pages"))


@query("""select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title, nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '') as h1, lower(nullif(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1), '')) as host from pages""")
def web2_titles(spark, sf_dir):
    from ..sources import web

    return web.headings(fixtures.table(spark, sf_dir, "pages"))
