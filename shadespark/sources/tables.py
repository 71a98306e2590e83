"""Readers and sinks of the engine's tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.checks import require_columns

RAW_ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("product_id", "shade_id", "brand_name", "product_name", "shade_name", "url", "chip_rgb")])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where that is unset, a local master takes a temporary folder, and a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shadespark-")  # one machine
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/shadespark-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that later filters do not reach into its plan."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """df as a side of an equi-join that grows with the input: joined by sorting, never sent to the driver.

    Spark tells what to broadcast by the size of files or shuffles, which compress uniform rows a hundredfold.
    """
    return df.hint("merge")


def read_inventory(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Catalogue scan with string ids; raises if a needed column is missing."""
    df = spark.read.option("header", True).csv(path) if form == "csv" else spark.read.format(form).load(path)
    require_columns(df, ("shade_id", "product_id", "L_lab", "a_lab", "b_lab"))
    return df.withColumns({c: F.col(c).cast("string") for c in ("shade_id", "product_id")})


def naming_probabilities(df: DataFrame, key: str = "chip_hex") -> DataFrame:
    """Lower-case key and the p_* columns, one row for each key."""
    probs = [c for c in df.columns if c.startswith("p_")]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in probs)))
    return df.withColumn(key, F.lower(key)).select(key, *probs).withColumn("_n", rank).where("_n = 1").drop("_n")


def read_parameters(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(name, level, value) of a nested object of numbers in a multi-line JSON file."""
    text = spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.{field}").alias("j"))
    outer = text.select(F.explode(F.from_json("j", "map<string,string>")).alias("name", "inner"))
    nested = outer.where(F.col("inner").startswith("{")).select("name", F.explode(F.from_json("inner", "map<string,double>")).alias("level", "value"))
    flat = outer.where(~F.col("inner").startswith("{")).select("name", F.lit(None).cast("string").alias("level"), F.col("inner").try_cast("double").alias("value"))
    return nested.unionByName(flat)


def read_score_files(spark: SparkSession, glob: str) -> DataFrame:
    """Score files, or folders of them, with query_id from their names: scored_<query_id>, with or without an ending."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/scored_([^/]+?)(\.csv|\.parquet)?(/|$)", 1)
    return spark.read.option("header", True).csv(glob).withColumn("query_id", name)


def colour_lists(blobs: DataFrame, column: str = "blob") -> DataFrame:
    """(source, name, hex) of JSON maps of lists whose fields have variant names."""
    item = "map<string,array<struct<name:string,title:string,label:string,hex:string,value:string,colour:string>>>"
    rows = blobs.select(F.explode(F.from_json(column, item)).alias("source", "items")).select("source", F.explode("items").alias("i"))
    return rows.select("source", F.coalesce("i.name", "i.title", "i.label").alias("name"), F.coalesce("i.hex", "i.value", "i.colour").alias("hex"))


def write_new_scores(scores: DataFrame, path: str, top: int) -> DataFrame:
    """The top rows of queries that path does not hold yet; appended there by query."""
    spark = scores.sparkSession
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "product_id", "shade_id"))
    fresh = scores.withColumn("_n", rank).where(F.col("_n") <= top).drop("_n")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        fresh = fresh.join(spark.read.parquet(path).select("query_id").distinct(), "query_id", "left_anti")
    fresh.write.mode("append").partitionBy("query_id").parquet(path)
    return fresh


def write_tables(df: DataFrame, path: str, form: str, order: list[str] | None = None) -> None:
    """CSV, Parquet or JSON sink; JSON in the order of keys."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", form == "csv").format(form).save(path)


def route_fetch_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with its status (no key: error), and the failures alone."""
    bad = F.col("shade_id").isNull() | (F.col("shade_id") == "")
    all_rows = log.withColumn("status", F.when(bad, "error").otherwise(F.col("status"))).withColumn("error", F.when(bad, "missing key").otherwise(F.col("error")))
    return all_rows, all_rows.where("status = 'error'")


# Fixed kinds and endings of images, in the order in which they are tried.
MEDIA = ("media_zoom", "media_main", "media_hero", "media_swatch", "media_full", "media_detail", "media_thumbnail")
ENDINGS = ("jpg", "jpeg", "webp", "avif", "png")
SCALE = "?scaleWidth=900&scaleHeight=900&scaleMode=fit"


def retry_candidates(failed: DataFrame) -> DataFrame:
    """shade_id, priority (from 0), candidate_url: each kind of image with each ending, at a stated size and as it is, and the given URL last. A URL without a kind stands for itself, with and without its query."""
    bare = F.regexp_extract("chip_url", r"^[^?]*", 0)
    base = F.regexp_extract(bare, r"^(.*)-media_[a-zA-Z0-9]+\.[a-zA-Z0-9]+$", 1)
    urls = F.array(*(F.concat(base, F.lit(f"-{m}.{e}{q}")) for m in MEDIA for e in ENDINGS for q in (SCALE, "")), F.col("chip_url"))
    return failed.select("shade_id", F.posexplode(F.when(base != "", urls).otherwise(F.array("chip_url", bare))).alias("priority", "candidate_url"))
