"""Readers, sinks, checks, stored pages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, relational
from ..plans import assets
from ..sources import fixtures, tables, web
from ..streaming import jobs
from .base import SHADES, query, with_
from .catalogue import BAD


@query(with_(SHADES, select="select shade_id, product_id, round(L_lab, 6) as L_lab, round(C_lab, 6) as C_lab from shades where r is not null"))
def src1_inventory(spark, sf_dir):
    """The enriched catalogue written as CSV, read again as an inventory."""
    path = tables.scratch(spark, "inventory")
    df = fixtures.shades(spark, sf_dir).where("r is not null").select("shade_id", "product_id", "L_lab", "a_lab", "b_lab", "C_lab")
    tables.write_tables(df, path, "csv")
    got = tables.read_inventory(spark, path, "csv")
    return got.select("shade_id", "product_id", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("L_lab", "C_lab")))


_DIMS = ("L_lab", "C_lab", "depth", "sat_eff", "light_hsl")
_LEVEL_SQL = " union all ".join(f"select '{d}' as name, '{lv}' as level, round(quantile_cont({d}, {q}), 5) as value from shades where r is not null" for d in _DIMS for lv, q in (("low", 0.35), ("medium", 0.5), ("high", 0.65), ("very_high", 0.8)))


@query(with_(SHADES, select=_LEVEL_SQL))
def src3_parameters(spark, sf_dir):
    """A calibration built from the catalogue, written as one JSON object and read as a table."""
    df = tables.stored(fixtures.shades(spark, sf_dir).where("r is not null"), "shades")
    protos = df.groupBy("cluster_id").agg(*(F.avg(c).alias(c) for c in ("L_lab", "a_lab", "b_lab")))
    _, dims = assets.build_calibration(df, protos)
    levels = F.create_map(*(x for n in ("low", "medium", "high", "very_high") for x in (F.lit(n), F.col(n))))
    blob = dims.where(F.col("dim").isin(*_DIMS)).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("dim", levels))).alias("thresholds"))).alias("value"))
    path = tables.scratch(spark, "calibration")
    blob.write.text(path)
    return tables.read_parameters(spark, path, "thresholds").withColumn("value", F.round("value", 5))


@query(with_(SHADES, "k as (select *, row_number() over (partition by cluster_id order by C_lab desc, product_id, shade_id) as rank from shades where r is not null)", select="select case cluster_id % 2 when 0 then 'even' else 'odd' end as query_id, shade_id, round(C_lab, 6) as score from k where rank <= 5"))
def src4_score_files(spark, sf_dir):
    """The first five of each cluster, written to one folder for each parity; the query id is read from the folder's name."""
    df = tables.stored(fixtures.shades(spark, sf_dir).where("r is not null").select("cluster_id", "product_id", "shade_id", "C_lab"), "scores")
    top = relational.top_per(df, ["cluster_id"], [F.desc("C_lab"), "product_id", "shade_id"], 5)
    path = tables.scratch(spark, "scored")
    for k, name in enumerate(("even", "odd")):
        tables.write_tables(top.where(F.col("cluster_id") % 2 == k).select("shade_id", F.col("C_lab").alias("score")), f"{path}/scored_{name}", "csv")
    return tables.read_score_files(spark, f"{path}/scored_*").select("query_id", "shade_id", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(with_(SHADES, select="select brand_name as source, shade_name as name, chip_hex as hex from shades where chip_hex is not null"))
def src5_colour_lists(spark, sf_dir):
    """Colour lists as JSON maps, whose fields go by one of three names."""
    k = F.col("shade_id").cast("long") % 3
    field = lambda names, c: F.array(*(F.lit(n) for n in names))[k.cast("int")]
    df = fixtures.shades(spark, sf_dir).where("chip_hex is not null")
    item = F.map_from_arrays(F.array(field(("name", "title", "label"), 0), field(("hex", "value", "colour"), 0)), F.array("shade_name", "chip_hex"))
    return tables.colour_lists(df.select(F.to_json(F.create_map("brand_name", F.array(item))).alias("blob")))


@query(with_(SHADES, "k as (select *, row_number() over (partition by cluster_id order by L_lab desc, product_id, shade_id) as r1, row_number() over (partition by cluster_id order by C_lab desc, product_id, shade_id) as r2 from shades where r is not null)",
    select="select cluster_id as query_id, shade_id from k where cluster_id < 4 and r1 <= 10 union all select cluster_id, shade_id from k where cluster_id >= 4 and r2 <= 10"))
def src6_new_scores(spark, sf_dir):
    """Scores of some queries are written; a second run with other scores for all adds only the queries that are missing."""
    df = tables.stored(fixtures.shades(spark, sf_dir).where("r is not null").select(F.col("cluster_id").alias("query_id"), "product_id", "shade_id", "L_lab", "C_lab"), "scores")
    path = tables.scratch(spark, "new-scores")
    tables.write_new_scores(df.where("query_id < 4").withColumn("score", F.col("L_lab")), path, 10)
    tables.write_new_scores(df.withColumn("score", F.col("C_lab")), path, 10)
    return spark.read.parquet(path).select(F.col("query_id").cast("int").alias("query_id"), "shade_id")


@query(with_(SHADES, select="select round(avg(case when r is not null then 1.0 else 0.0 end), 9) as share, avg(case when r is not null then 1.0 else 0.0 end) >= 0.95 as enough from shades"))
def chk3_coverage(spark, sf_dir):
    return checks.coverage(fixtures.shades(spark, sf_dir), "r").withColumn("share", F.round("share", 9))


@query(with_(SHADES, select="select bool_or(L_lab is null or C_lab is null) as has_gap, string_agg(distinct cast(cluster_id as varchar), ',' order by cast(cluster_id as varchar)) as labels from shades"))
def chk4_training(spark, sf_dir):
    got = checks.training_check(fixtures.shades(spark, sf_dir), ["L_lab", "C_lab"], "cluster_id")
    return got.select("has_gap", F.concat_ws(",", F.col("labels").cast("array<string>")).alias("labels"))


_OTHERS = "raw2 as (select shade_id, product_name || (['', ' Blush', ' tinted', ' Fards à joues', ' matte'])[cast(shade_id as bigint) % 5 + 1] as product_name, shade_name from raw)"


@query(with_(SHADES, _OTHERS, select="select shade_id, product_name from raw2 where not regexp_matches(lower(product_name || ' ' || shade_name), 'blush|joues|tint')"))
def flt7_category(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, ("", " Blush", " tinted", " Fards à joues", " matte"))), (F.col("shade_id").cast("long") % 5 + 1).cast("int"))
    return relational.in_category(fixtures.raw_items(spark, sf_dir).withColumn("product_name", F.concat("product_name", tail))).select("shade_id", "product_name")


_SPACE = web.SPACE
_HOST = "https://media.example/content/published/M/MAISON/1/"


def _chip(id_, j):
    """SQL of a chip image URL."""
    return f"'{_HOST}' || ({id_}) || '-media_thumbnail.jpg?scaleWidth={j}'"


# SQL of the data that shop pages hold before their own HTML, by page_id % 8; n is page_id as text, s(j) a shade number.
_S = [f"(page_id * 10 + {j})" for j in range(4)]
_SKU = [
    f"""'{{"skuId": "' || {{id}} || '", "variationValue": " Tone\\u00a0 ' || n || '  {j} ", "swatchImage": "' || {_chip(_S[j], j)} || '"}}'""" for j in range(3)
]
_DATA = {
    # the product node: ids that the chip's file name repairs, one SKU without name, one of a foreign host, one twice
    0: """'{"props": {"pageProps": {"product": {"displayName": "  Lip  ' || n || ' ", "brand": {"name": "Maison ' || (page_id % 7) || '"}, "skus": [' || """
    + " || ', ' || ".join(x.replace("{id}", f"'X{j}'") for j, x in enumerate(_SKU))
    + """ || ', {"skuId": "9", "swatch": "' || """ + _chip(_S[3], 3) + """ || '"}, {"skuId": "8", "label": "Far", "swatchUrl": "https://other.example/8-media_thumbnail.jpg"}, ' || """ + _SKU[1].replace("{id}", "'X1'") + """ || ']}}}}'""",
    # no SKUs at the product: all nodes are walked; numbers as ids, a chip without a number in its name
    1: """'{"props": {"pageProps": {"product": {"displayName": "", "productName": "Lip ' || n || '", "brandName": "House ' || (page_id % 5) || '"}, "blocks": [{"kind": "text"}, {"items": [[{"id": ' || n || ', "value": "Deep ' || n || '", "swatch": "' || """
    + _chip(_S[0], 0) + """ || '"}], {"variantId": "V' || n || '", "label": "Named", "swatchUrl": "https://media.example/a/chip-media_thumbnail.jpg"}, {"name": "No id", "swatch": "https://media.example/a/other-media_thumbnail.jpg"}]}]}}}'""",
    # no product node: the first node with a name and a brand gives both; a text that looks like JSON is a text
    2: """'{"page": {"list": [{"title": "No brand here"}, {"title": "Lip ' || n || '", "brand": " Atelier  ' || (page_id % 3) || '", "note": "{\\"name\\": \\"fake\\", \\"brand\\": \\"fake\\"}", "colours": {"b": {"shadeId": "7", "shadeName": "B", "swatch": "' || """
    + _chip(_S[1], 1) + """ || '"}, "a": {"shadeId": "6", "shadeName": "A", "swatch": "' || """ + _chip(_S[0], 0) + """ || '"}}}]}}'""".replace('\\\\"', '\\"'),
    6: "'{\"props\": {\"pageProps\": {\"product\": {\"name\": \"broken\", '",
    7: """'{"props": {"pageProps": {"product": {"name": "Lip ' || n || '", "skus": [' || """ + _SKU[0].replace("{id}", "'Y'") + """ || ']}}}}'""",
}
_IMAGES = [f"""'<img alt="Shade ' || {x} || '" src="' || {_chip(x, j)} || '">'""" for j, x in enumerate(_S[:2])] + [f"""'<img title="Titled" src="' || {_chip(_S[2], 2)} || '"><img src="' || {_chip(_S[3], 3)} || '"><img alt="far" src="https://other.example/1-media_thumbnail.jpg">'"""]
_LEAD = "case page_id % 8 " + " ".join(f"""when {k} then '<script id="__NEXT_DATA__" type="application/json">' || {v} || '</script>'""" for k, v in _DATA.items()) + f"""
  when 3 then '<script type="application/ld+json">[{{"@type": "Thing", "name": "not this"}}]</script><script type="application/ld+json">{{"@type": ["Thing", "Product"], "name": "Linked ' || n || '", "brand": {{"name": "Linked House"}}}}</script>' || {" || ".join(_IMAGES)}
  when 4 then '<div class="x"><span>A</span><a href="/b">Brand ' || (page_id % 6) || '</a><div></div></div><h1 id="t">Marked <b>up</b> ' || n || '</h1>' || {" || ".join(_IMAGES)}
  when 5 then '<h1>Alone ' || n || '</h1>' || {_IMAGES[0]} else '' end"""
_PAGES = f"""pg as (select page_id, 'https://shop.example/p/x-' || case when page_id % 16 = 15 then 'Q' else 'p' end || page_id || '.html' as url, ({_LEAD}) || html as html from (select *, cast(page_id as varchar) as n from pages))"""
_WALK = r"""js as (select page_id, try_cast(nullif(regexp_extract(html, '(?is)<script[^>]*__NEXT_DATA__[^>]*>(.*?)</script>', 1), '') as json) as j from pg),
wk as (select page_id, []::varchar[] as path, j from js where j is not null union all
  select w.page_id, list_append(w.path, case when json_type(w.j) = 'ARRAY' then lpad(e.key, 8, '0') else e.key end), e.value from wk w, json_each(w.j) e where json_type(w.j) in ('OBJECT', 'ARRAY')),
nd as (select page_id, path, j from wk where json_type(j) = 'OBJECT')"""


def _txt(j, *names):
    """SQL: the first of these fields of j with a text or number, squeezed."""
    return "nullif(trim(regexp_replace(coalesce(" + ", ".join(f"case when json_type({j}->'$.{n}') not in ('OBJECT', 'ARRAY', 'NULL') then nullif({j}->>'$.{n}', '') end" for n in names) + rf"), '{_SPACE}', ' ', 'g')), '')"


def _brand_sql(j, more):
    return f"coalesce(case when json_type({j}->'$.brand') = 'OBJECT' then {_txt(j + chr(45) + '>' + chr(39) + '$.brand' + chr(39), 'name')} else {_txt(j, 'brand')} end{more})"


_CHIP = r"'(?i)^https://media\.[^/]+/.*-media_thumbnail\.jpg'"
_FILE = r"nullif(regexp_extract(string_split(chip_url, '?')[1], '(?i)/(\d+)-media_thumbnail\.jpg', 1), '')"
_VARIANTS = rf"""pr as (select page_id, case when json_type(j->'$.props.pageProps.product') = 'OBJECT' then j->'$.props.pageProps.product' end as p from js),
v1 as (select page_id, [k] as path, sku_id, shade_name, chip_url from (select page_id, lpad(k::varchar, 8, '0') as k, {_txt('s', *web.SKU_ID)} as sku_id, {_txt('s', *web.SKU_NAME)} as shade_name, {_txt('s', *web.SKU_CHIP)} as chip_url
  from (select page_id, unnest(p->'$.skus[*]') as s, generate_subscripts(p->'$.skus[*]', 1) as k from pr)) where sku_id is not null and shade_name is not null and regexp_matches(chip_url, {_CHIP})),
v2 as (select page_id, path, coalesce({_FILE}, sku_id) as sku_id, shade_name, chip_url from (select page_id, path, {_txt('j', *web.SKU_ID, 'variantId')} as sku_id, {_txt('j', *web.SKU_NAME, 'value')} as shade_name, {_txt('j', *web.SKU_CHIP)} as chip_url from nd)
  where shade_name is not null and regexp_matches(chip_url, {_CHIP}) and coalesce({_FILE}, sku_id) is not null),
im as (select page_id, unnest(t) as t, generate_subscripts(t, 1) as k from (select page_id, regexp_extract_all(html, '(?is)<img\s[^>]*>') as t from pg)),
v3 as (select page_id, [lpad(k::varchar, 8, '0')] as path, {_FILE} as sku_id, shade_name, chip_url from (select page_id, k, regexp_extract(t, '(?is)\ssrc\s*=\s*"([^"]*)"', 1) as chip_url,
  nullif(trim(regexp_replace(coalesce(nullif(regexp_extract(t, '(?is)\salt\s*=\s*"([^"]*)"', 1), ''), regexp_extract(t, '(?is)\stitle\s*=\s*"([^"]*)"', 1)), '{_SPACE}', ' ', 'g')), '') as shade_name from im) where regexp_matches(chip_url, {_CHIP}) and {_FILE} is not null),
vs as (select * from v1 union all select * from v2 where page_id not in (select page_id from v1) union all select * from v3 where page_id not in (select page_id from v1) and page_id not in (select page_id from v2)),
vd as (select page_id, sku_id, chip_url, min(path) as path, arg_min(coalesce(shade_name, ''), path) as shade_name from vs group by all)"""
_NAMED = rf"""n1 as (select page_id, {_txt('p', *web.NAME)} as name, {_brand_sql('p', ', ' + _txt('p', web.BRAND))} as brand from pr where p is not null),
n2 as (select page_id, arg_min(name, path) as name, arg_min(brand, path) as brand from (select nd.page_id, path, {_txt('j', *web.NAME)} as name, {_brand_sql('j', ', ' + _txt('j', web.BRAND))} as brand from nd join pr on pr.page_id = nd.page_id and p is null) where name is not null and brand is not null group by page_id),
ld as (select page_id, try_cast(unnest(l) as json) as j, generate_subscripts(l, 1) as k from (select page_id, regexp_extract_all(html, '(?is)<script[^>]*type=.application/ld\+json.[^>]*>(.*?)</script>', 1) as l from pg)),
le as (select page_id, k, unnest(case when json_type(j) = 'ARRAY' then j->'$[*]' else [j] end) as j from ld where j is not null),
n3 as (select page_id, arg_min(coalesce(name, ''), k) as name, arg_min(coalesce(brand, ''), k) as brand from (select page_id, k, {_txt('j', 'name')} as name, {_brand_sql('j', '')} as brand from le where j->>'$."@type"' = 'Product' or list_contains(j->>'$."@type"[*]', 'Product')) where name is not null or brand is not null group by page_id),
n4 as (select page_id, h as name, list_filter(list_transform(list_reverse(t)[1:80], lambda x: nullif(trim(regexp_replace(x, '{_SPACE}', ' ', 'g')), '')), lambda x: length(x) between 2 and 60 and x is distinct from h)[1] as brand
  from (select page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '{_SPACE}', ' ', 'g')), '') as h, regexp_extract_all(regexp_extract(html, '(?is)^(.*?)<h1[^>]*>', 1), '(?is)<(?:a|div|span)(?:\s[^>]*)?>([^<]*)', 1) as t from pg)),
nm as (select pg.page_id, url, coalesce(n1.name, n2.name, nullif(n3.name, ''), n4.name) as product_name, coalesce(n1.brand, n2.brand, nullif(n3.brand, ''), n4.brand) as brand_name
  from pg left join n1 using (page_id) left join n2 using (page_id) left join n3 using (page_id) left join n4 using (page_id))"""


def _shop_pages(spark, sf_dir):
    """Pages with the given HTML behind product data: a product node, data to be walked, JSON-LD, plain markup, or broken data."""
    p = fixtures.table(spark, sf_dir, "pages").withColumn("n", F.col("page_id").cast("string"))
    lead = F.expr(_LEAD.replace("\\", "\\\\"))
    letter = F.when(F.col("page_id") % 16 == 15, "Q").otherwise("p")
    return p.select("page_id", F.concat(F.lit("https://shop.example/p/x-"), letter, "n", F.lit(".html")).alias("url"), F.concat(lead, "html").alias("html"))


def _with_pages(*parts, select):
    return "with recursive " + ",\n".join((_PAGES, _WALK, *parts)) + "\n" + select


@query(_with_pages(select="select page_id, array_to_string(path, '/') as path, cast(len(json_keys(j)) as integer) as fields from nd"))
def web3_walk(spark, sf_dir):
    """Every object in the pages' data, at any depth."""
    nodes = web.walked(_shop_pages(spark, sf_dir)).select("page_id", F.explode("nodes").alias("x"))
    return nodes.select("page_id", F.array_join("x.path", "/").alias("path"), F.size(F.try_variant_get("x.v", "$", "map<string,variant>")).alias("fields"))


@query(_with_pages(_VARIANTS, _NAMED, select="select page_id, url, product_name, brand_name from nm"))
def web2_products(spark, sf_dir):
    return web.products(web.walked(_shop_pages(spark, sf_dir)))


@query(_with_pages(_VARIANTS, select="select page_id, sku_id, nullif(shade_name, '') as shade_name, chip_url, row_number() over (partition by page_id order by path) as k from vd"))
def web3_variants(spark, sf_dir):
    from pyspark.sql.window import Window

    got = web.variants(web.walked(_shop_pages(spark, sf_dir)))
    return got.select("page_id", "sku_id", "shade_name", "chip_url", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("long").alias("k"))


@query(
    _with_pages(
        _VARIANTS, _NAMED,
        r"cb as (select page_id, arg_min(b, path) as b from (select page_id, path, nullif(trim(regexp_extract(chip_url, '(?i)/published/[A-Z]/([^/]+)/', 1)), '') as b from vd) where b is not null group by page_id)",
        rf"""it as (select nullif(upper(regexp_extract(url, '(?i)-(P\d+)\.html', 1)), '') as product_id, coalesce({_FILE}, sku_id) as shade_id, coalesce(brand_name, cb.b) as brand_name, product_name, nullif(shade_name, '') as shade_name, url, chip_url, page_id, path
  from vd join nm using (page_id) left join cb using (page_id))""",
        select="select product_id, shade_id, brand_name, product_name, shade_name, url, chip_url from (select *, row_number() over (partition by product_id, shade_id order by page_id, path) as k from it where product_id is not null and brand_name is not null and product_name is not null and shade_name is not null) where k = 1",
    )
)
def web4_items(spark, sf_dir):
    pages = _shop_pages(spark, sf_dir)
    return web.item_rows(pages.unionByName(pages.where("page_id % 4 = 0").withColumn("page_id", F.col("page_id") + 10_000_000)))  # repeated pages give their items once


@query("""select page_id, case when starts_with(link, '/') then regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || link else link end as link, k from (select page_id, url, unnest(l) as link, generate_subscripts(l, 1) - 1 as k from (
  select page_id, url, list_filter(f, lambda x, i: list_position(f, x) = i) as l from (select page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) as f from pages)))""")
def web1_absolute(spark, sf_dir):
    p = fixtures.table(spark, sf_dir, "pages")
    return web.absolute(p, web.links(p)).select("page_id", "link", F.col("pos").alias("k"))


@query(with_(SHADES, select=f"select s.shade_id, s.chip_hex, round(s.L_lab, 6) as L_lab from shades s where not {BAD}"))
def str1_enrich(spark, sf_dir):
    """Raw items that arrive as JSON files, enriched by the stream, read from its sink."""
    source, sink = tables.scratch(spark, "arriving"), tables.scratch(spark, "enriched")
    fixtures.raw_items(spark, sf_dir).drop("cluster_id").write.json(source)
    jobs.enrich_stream(spark, source, sink, tables.scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(sink).select("shade_id", "chip_hex", F.round("L_lab", 6).alias("L_lab"))


@query("""with k as (select p_partkey as shade_id, '  ' || upper(p_name) || '_(' || p_brand || ') / ' || p_type || '-' || p_size as raw, 'https://shop.example/a/' || p_partkey || '?q=1#top' as url, case when p_partkey % 3 = 0 then ' ' else p_name end as one from part)
select shade_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(raw), '[_/\\\\-]+', ' ', 'g'), '[^a-z0-9\\s]+', '', 'g'), '\\s+', ' ', 'g')) as key, 'https://shop.example/a/' || shade_id as bare, 'https://shop.example/a/' || shade_id || '?size=2' as resized,
  nullif(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '') as squeezed, case when shade_id % 3 = 0 then 'none' else one end as first from k""")
def fun2_keys(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("_("), "p_brand", F.lit(") / "), "p_type", F.lit("-"), F.col("p_size").cast("string"))
    url = F.concat(F.lit("https://shop.example/a/"), k.cast("string"), F.lit("?q=1#top"))
    one = F.when(k % 3 == 0, " ").otherwise(F.col("p_name"))
    return fixtures.table(spark, sf_dir, "part").select(k.alias("shade_id"), text.key(raw).alias("key"), text.url_bare(url).alias("bare"), text.url_with(url, "size=2").alias("resized"), text.squeezed(raw).alias("squeezed"), text.first_of(one, F.lit("none")).alias("first"))


_WORDS = "wd as (select distinct lower(w) || (['', 's', 'ish', 'y', 'ies'])[p_partkey % 5 + 1] as t from (select p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) as w from part))"
_VARIANTS = """vr as (select t, t as v, 0 as o from wd union select t, substr(t, 1, length(t) - 3), 1 from wd where length(t) >= 5 and ends_with(t, 'ish')
  union select t, substr(t, 1, length(t) - 1), 2 from wd where length(t) >= 4 and ends_with(t, 'y') union select t, substr(t, 1, length(t) - 1), 3 from wd where length(t) >= 5 and ends_with(t, 's') and not regexp_matches(t, '(ss|us|is)$'))"""


def _words(spark, sf_dir):
    p = fixtures.table(spark, sf_dir, "part")
    w = F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))
    tail = F.element_at(F.array(*map(F.lit, ("", "s", "ish", "y", "ies"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(tail.alias("tail"), w.alias("w")).select(F.concat("w", "tail").alias("t")).distinct()


@query(with_(_WORDS, _VARIANTS, select="select t, string_agg(v, ' ' order by o) as variants from vr group by t"))
def fun6_variants(spark, sf_dir):
    return _words(spark, sf_dir).select("t", F.array_join(text.variants(F.col("t")), " ").alias("variants"))


@query(with_(_WORDS, _VARIANTS, "ix as (select distinct lower(w) as k from (select unnest(string_split(p_name, ' ')) as w from part))",
    select="select t, coalesce((select arg_min(v, struct_pack(o := case when v = t then 0 else 1 end, n := length(v), v := v)) from vr where vr.t = wd.t and v in (select k from ix)), t) as preferred from wd"))
def fun7_preferred(spark, sf_dir):
    keys = fixtures.table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("v")).distinct()
    words = _words(spark, sf_dir)
    present = words.select("t", F.explode(text.variants(F.col("t"))).alias("v")).join(keys, "v").groupBy("t").agg(F.collect_set("v").alias("present"))
    return words.join(present, "t", "left").select("t", text.preferred(F.col("t"), F.coalesce("present", F.array().cast("array<string>"))).alias("preferred"))


@query(with_(_WORDS, _VARIANTS, select="select v as alias, min(t) as key from vr where v <> t and not (ends_with(t, 'y') and v || 'y' = t) and v not in (select t from wd) group by v"))
def fun8_aliases(spark, sf_dir):
    return assets.derived_aliases(_words(spark, sf_dir).select(F.col("t").alias("key")))

