"""Stored pages: links, headings and embedded item data as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Levels of embedded JSON that are walked; deeper nodes are not seen.
DEPTH = 24
#: Chip images of any media host; ids and brands in their paths.
CHIP = r"(?i)^https://media\.[^/]+/.*-media_thumbnail\.jpg"
CHIP_ID, CHIP_BRAND = r"(?i)/(\d+)-media_thumbnail\.jpg", r"(?i)/published/[A-Z]/([^/]+)/"
# Fixed field names, the first that is not empty counts.
NAME, BRAND = ("displayName", "productName", "name", "title"), "brandName"
SKU_ID, SKU_NAME, SKU_CHIP = ("skuId", "shadeId", "id"), ("variationValue", "shadeName", "name", "label"), ("swatchImage", "swatchUrl", "swatch")

#: White space of any alphabet.
SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]+"
_NODES = "array<struct<path:array<string>,v:variant>>"


def links(pages: DataFrame, pattern: str | None = None) -> DataFrame:
    """page_id, pos, link: distinct href values in order, those that match pattern."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    if pattern:
        found = F.filter(found, lambda x: x.rlike(pattern))
    return pages.select("page_id", F.posexplode(found).alias("pos", "link"))


def absolute(pages: DataFrame, links_: DataFrame) -> DataFrame:
    """links with root-relative ones completed by their page's host."""
    root = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    j = links_.join(pages.select("page_id", root.alias("_root")), "page_id")
    return j.withColumn("link", F.when(F.col("link").startswith("/"), F.concat("_root", "link")).otherwise(F.col("link"))).drop("_root")


def headings(pages: DataFrame) -> DataFrame:
    one = lambda tag: F.nullif(F.trim(F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return pages.select("page_id", one("title").alias("title"), one("h1").alias("h1"), text.url_host(F.col("url")).alias("host"))


def squeezed(c: Column) -> Column:
    """White space squeezed and trimmed, NULL if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, SPACE, " ")), F.lit(""))


def walk(json: Column, depth: int = DEPTH) -> tuple[dict[str, Column], Column]:
    """(columns, nodes): the objects of a JSON text as array<struct<path, v>>, v a VARIANT, parents first by path.

    A path lists keys and eight-digit indexes; JSON gives the keys of an object no order, so siblings come by key.
    The columns, added one after the other, hold the levels; nodes reads them. NULL or broken text has no nodes.
    """
    empty = F.array().cast(_NODES)
    levels = {"_v": F.try_parse_json(json), "_0": F.when(F.col("_v").isNotNull(), F.array(F.struct(F.array().cast("array<string>").alias("path"), F.col("_v").alias("v")))).otherwise(empty)}

    def children(x: Column) -> Column:
        node = lambda step, v: F.struct(F.concat(x["path"], F.array(step)).alias("path"), v.alias("v"))
        fields = F.transform(F.map_entries(_as(x["v"], "map<string,variant>")), lambda e: node(e["key"], e["value"]))
        return F.coalesce(fields, F.transform(_as(x["v"], "array<variant>"), lambda e, i: node(F.lpad(i.cast("string"), 8, "0"), e)), empty)

    for k in range(depth):
        levels[f"_{k + 1}"] = F.flatten(F.transform(f"_{k}", children))
    return levels, F.filter(F.concat(*(f"_{k}" for k in range(depth + 1))), lambda x: _as(x["v"], "map<string,variant>").isNotNull())


def _as(v: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, kind)


def _first(v: Column, names: tuple[str, ...]) -> Column:
    """The first of these fields that holds a text or number other than the empty text, squeezed; objects and arrays are no text."""
    plain = lambda n: F.when(_as(v, "map<string,variant>", f"$.{n}").isNull() & _as(v, "array<variant>", f"$.{n}").isNull(), F.nullif(_as(v, "string", f"$.{n}"), F.lit("")))
    return squeezed(F.coalesce(*map(plain, names)))


def _brand(v: Column, *more: str) -> Column:
    """The name of the brand object, or the brand text, or else one of the fields in more."""
    named = F.when(_as(v, "map<string,variant>", "$.brand").isNotNull(), squeezed(_as(v, "string", "$.brand.name"))).otherwise(_first(v, ("brand",)))
    return F.coalesce(named, *(_first(v, (m,)) for m in more))


def _scripts(mark: str) -> Column:
    return F.regexp_extract_all("html", F.lit(rf"(?is)<script[^>]*{mark}[^>]*>(.*?)</script>"), F.lit(1))


def walked(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """pages with app, the page's data as a VARIANT, product, the node at props.pageProps.product if that is an object, and nodes, all objects of the data in walk order."""
    levels, nodes = walk(F.get(_scripts("__NEXT_DATA__"), F.lit(0)), depth)
    out = pages
    for name, column in levels.items():
        out = out.withColumn(name, column)
    at = _as(F.col("_v"), "variant", "$.props.pageProps.product")
    product = F.when(_as(at, "map<string,variant>").isNotNull(), at)
    ordered = F.array_sort(nodes, lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    return out.select(*pages.columns, F.col("_v").alias("app"), product.alias("product"), ordered.alias("nodes"))


def _linked_data() -> Column:
    """(name, brand) of the first Product of the page's JSON-LD that has either."""
    parsed = F.transform(_scripts(r"type=.application/ld\+json."), lambda s: F.try_parse_json(s))
    nodes = F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), lambda v: F.coalesce(_as(v, "array<variant>"), F.array(v))))
    kind = lambda v: F.coalesce(F.array_contains(_as(v, "array<string>", '$["@type"]'), "Product"), _as(v, "string", '$["@type"]') == "Product", F.lit(False))
    found = F.transform(F.filter(nodes, kind), lambda v: F.struct(_first(v, ("name",)).alias("name"), _brand(v).alias("brand")))
    return F.get(F.filter(found, lambda x: x["name"].isNotNull() | x["brand"].isNotNull()), F.lit(0))


def _headed() -> Column:
    """(name, brand) of the markup: the first h1, and the nearest text of 2 to 60 characters at the beginning of one of the 80 links, divisions and spans before it."""
    plain = lambda c: squeezed(F.regexp_replace(c, r"<[^>]*>", " "))
    name = plain(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    before = F.regexp_extract("html", r"(?is)^(.*?)<h1[^>]*>", 1)
    texts = F.transform(F.slice(F.reverse(F.regexp_extract_all(before, F.lit(r"(?is)<(?:a|div|span)(?:\s[^>]*)?>([^<]*)"), F.lit(1))), 1, 80), squeezed)
    brand = F.get(F.filter(texts, lambda t: (F.length(t) >= 2) & (F.length(t) <= 60) & ~t.eqNullSafe(name)), F.lit(0))
    return F.struct(name.alias("name"), brand.alias("brand"))


def products(pages: DataFrame) -> DataFrame:
    """page_id, url, product_name, brand_name of walked pages: of the product node, or of the first node with a name and a brand where there is none; then of the JSON-LD; then of the markup."""
    pair = F.filter(F.transform("nodes", lambda x: F.struct(_first(x["v"], NAME).alias("name"), _brand(x["v"], BRAND).alias("brand"))), lambda x: x["name"].isNotNull() & x["brand"].isNotNull())
    own = F.struct(_first(F.col("product"), NAME).alias("name"), _brand(F.col("product"), BRAND).alias("brand"))
    data = F.when(F.col("product").isNotNull(), own).otherwise(F.get(pair, F.lit(0)))
    each = pages.withColumn("_data", data).withColumn("_ld", _linked_data()).withColumn("_dom", _headed())
    pick = lambda field: F.coalesce(F.col(f"_data.{field}"), F.col(f"_ld.{field}"), F.col(f"_dom.{field}"))
    return each.select("page_id", "url", pick("name").alias("product_name"), pick("brand").alias("brand_name"))


def _file_id(chip: Column) -> Column:
    return F.nullif(F.regexp_extract(F.substring_index(chip, "?", 1), CHIP_ID, 1), F.lit(""))


def variants(pages: DataFrame) -> DataFrame:
    """page_id, pos, sku_id, shade_name, chip_url of walked pages, distinct by id and chip in order: of the product's SKUs,
    else of all nodes with a chip image, whose id is the one in the chip's file name if that has one, else of chip images
    (the only ones that may lack a name)."""
    sku = lambda v, ids, names: F.struct(_first(v, ids).alias("sku_id"), _first(v, names).alias("shade_name"), _first(v, SKU_CHIP).alias("chip_url"))
    whole = lambda s: s["sku_id"].isNotNull() & s["shade_name"].isNotNull() & s["chip_url"].rlike(CHIP)
    listed = F.filter(F.transform(_as(F.col("product"), "array<variant>", "$.skus"), lambda v: sku(v, SKU_ID, SKU_NAME)), whole)
    repaired = lambda s: F.struct(F.coalesce(_file_id(s["chip_url"]), s["sku_id"]).alias("sku_id"), s["shade_name"].alias("shade_name"), s["chip_url"].alias("chip_url"))
    anywhere = F.transform("nodes", lambda x: sku(x["v"], (*SKU_ID, "variantId"), (*SKU_NAME, "value")))
    anywhere = F.filter(F.transform(F.filter(anywhere, lambda s: s["shade_name"].isNotNull() & s["chip_url"].rlike(CHIP)), repaired), lambda s: s["sku_id"].isNotNull())
    quoted = lambda tag, name: F.nullif(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    images = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)(<img\s[^>]*>)"), F.lit(1)), lambda t: F.struct(_file_id(F.trim(quoted(t, "src"))).alias("sku_id"), squeezed(F.coalesce(quoted(t, "alt"), quoted(t, "title"))).alias("shade_name"), F.trim(quoted(t, "src")).alias("chip_url")))
    images = F.filter(images, lambda s: s["chip_url"].rlike(CHIP) & s["sku_id"].isNotNull())
    some = lambda name: F.when(F.size(name) > 0, F.col(name))
    each = pages.select("page_id", listed.alias("_listed"), anywhere.alias("_anywhere"), images.alias("_images"))
    rows = each.select("page_id", F.posexplode(F.coalesce(some("_listed"), some("_anywhere"), F.col("_images"))).alias("pos", "s")).select("page_id", "pos", "s.*")
    return rows.groupBy("page_id", "sku_id", "chip_url").agg(F.min_by(F.struct("pos", "shade_name"), "pos").alias("s")).select("page_id", "s.pos", "sku_id", "s.shade_name", "chip_url")


def item_rows(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Raw items of pages: product_id, shade_id, brand_name, product_name, shade_name, url, chip_url.

    A page needs a product id in its URL, a product name and a brand, which may come from a chip's path as a last resort;
    a shade needs a name and a chip, and takes its id from the chip's file name if that has one. The first page (by page_id)
    and shade of each (product_id, shade_id) stays.
    """
    from ..operators.relational import first_per
    from .tables import stored

    each = stored(walked(pages.select("page_id", "url", "html"), depth).select("page_id", "url", "html", "product", "nodes"), "walked")
    shades = variants(each)
    last = shades.withColumn("_b", squeezed(F.regexp_extract("chip_url", CHIP_BRAND, 1))).groupBy("page_id").agg(F.min_by("_b", F.when(F.col("_b").isNotNull(), F.col("pos"))).alias("_chip_brand"))
    j = products(each).join(shades, "page_id").join(last, "page_id", "left").withColumn("brand_name", F.coalesce("brand_name", "_chip_brand"))
    j = j.withColumns({"product_id": F.upper(F.nullif(F.regexp_extract("url", r"(?i)-(P\d+)\.html", 1), F.lit(""))), "shade_id": F.coalesce(_file_id(F.col("chip_url")), F.col("sku_id"))})
    j = j.where("product_id is not null and brand_name is not null and product_name is not null and shade_name is not null")
    return first_per(j, ["product_id", "shade_id"], ["page_id", "pos"]).select("product_id", "shade_id", "brand_name", "product_name", "shade_name", "url", "chip_url")
