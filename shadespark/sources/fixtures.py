"""Catalogues, anchors and wishes derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color

# Fixed anchors: name and hex.
ANCHORS = (
    ("red", "#ff0000"), ("pink", "#fe46a5"), ("fuchsia", "#ff00ff"), ("purple", "#7e1e9c"), ("mauve", "#e0b0ff"), ("orange", "#ff8000"),
    ("coral", "#ff7f50"), ("peach", "#ffe5b4"), ("brown", "#964b00"), ("nude", "#e6c2b3"), ("beige", "#a67b5b"), ("blue", "#0000ff"),
    ("green", "#15b01a"), ("yellow", "#f5bd1f"), ("black", "#3b3c36"), ("white", "#ffffff"), ("gray", "#86949f"),
)
# Fixed naming model: label, L, a, b.
NAMES = (("brown", 39.3, 36.1, 20.5), ("coral", 55.0, 50.0, 34.0), ("pink", 50.0, 55.0, 0.0), ("red", 42.0, 62.0, 38.0), ("taupe", 55.0, 12.0, 12.0))
LABELS = tuple(n[0] for n in NAMES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table part over all cores: its file is small, so that one task would read it, and what follows takes long for every row."""
    return table(spark, sf_dir, "part").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each part, four shades to a product, some without a valid colour, some ineligible."""
    p = parts(spark, sf_dir)
    k, s = F.col("p_partkey"), F.col("p_size")
    group = F.floor(k / 4).cast("bigint").cast("string")
    suffix = F.when(k % 40 == 7, " refill").when(k % 200 == 11, " étui").otherwise("")
    channel = lambda base, kk, ss, mod: (base + (k * kk + s * ss) % mod).cast("string")
    rgb = F.when(k % 97 == 5, "n/a").when(k % 89 == 3, "300,10,10").otherwise(F.concat_ws(",", channel(120, 37, 11, 136), channel(20, 53, 7, 160), channel(20, 29, 13, 170)))
    return p.select(
        F.concat(F.lit("P"), group).alias("product_id"),
        k.cast("string").alias("shade_id"),
        F.col("p_brand").alias("brand_name"),
        F.concat("p_type", F.lit(" "), "p_name", suffix).alias("product_name"),
        F.concat("p_name", F.lit(" "), s.cast("string")).alias("shade_name"),
        F.concat(F.lit("https://shop.example/p/item-P"), group, F.lit(".html")).alias("url"),
        (k % 8).cast("int").alias("cluster_id"),
        rgb.alias("chip_rgb"),
    )


def shades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched catalogue."""
    return color.enrich(raw_items(spark, sf_dir))


def anchors(spark: SparkSession) -> DataFrame:
    """query_id, anchor_hex, anchor_L, anchor_a, anchor_b, anchor_C, anchor_hue (HSV)."""
    df = spark.createDataFrame(list(ANCHORS), "query_id string, anchor_hex string")
    L, a, b = color.hex_lab(F.col("anchor_hex"))
    df = df.withColumns({"anchor_L": L, "anchor_a": a, "anchor_b": b})
    return df.withColumns({"anchor_C": color.chroma(F.col("anchor_a"), F.col("anchor_b")), "anchor_hue": color.hsv_hue(*color.hex_rgb01(F.col("anchor_hex")))})


def naming(shades_: DataFrame) -> DataFrame:
    """shades with the row-local naming probabilities p_<label>."""
    weight = {f"p_{n}": F.exp(-(F.pow(F.col("L_lab") - l0, F.lit(2.0)) + F.pow(F.col("a_lab") - a0, F.lit(2.0)) + F.pow(F.col("b_lab") - b0, F.lit(2.0))) / 200) for n, l0, a0, b0 in NAMES}
    df = shades_.withColumns(weight).withColumn("_all", sum(F.col(c) for c in weight))
    return df.withColumns({c: F.try_divide(F.col(c), F.col("_all")) for c in weight}).drop("_all")


def naming_long(shades_: DataFrame) -> DataFrame:
    """(shade_id, product_id, label, p, L_lab, a_lab, b_lab, C_lab, H_lab_deg), one row for each label."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.col(f"p_{n}").alias("p")) for n in LABELS))).alias("x")
    return naming(shades_).where("r is not null").select("shade_id", "product_id", "chip_hex", "L_lab", "a_lab", "b_lab", "C_lab", "H_lab_deg", pairs).select("*", "x.*").drop("x")


def label_keys(embeddings: DataFrame) -> DataFrame:
    """label, key_id, key: the first vector of each label."""
    return embeddings.groupBy("label").agg(F.min("vec_id").alias("key_id"), F.min_by("embedding", "vec_id").alias("key"))
