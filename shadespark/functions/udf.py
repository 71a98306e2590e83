"""Pandas UDFs, and column functions registered for SQL."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

@F.pandas_udf(DoubleType())
def ratcliff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2M / T by Ratcliff-Obershelp; NULL if either is."""
    return pd.Series([None if x is None or y is None else 100 * difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _characters(df: DataFrame, name: str) -> DataFrame:
    """name, _n (length), _t: its characters, each with the number of its occurrence so far, so that sets of them overlap as multisets do."""
    c = F.filter(F.split(name, ""), lambda x: x != "")
    df = df.select(name, F.length(name).alias("_n"), c.alias("_c"))
    return df.select(name, "_n", F.transform("_c", lambda x, i: F.concat(x, F.size(F.filter(F.slice("_c", 1, i + 1), lambda y: y == x)))).alias("_t"))


def fuzzy_matches(words: DataFrame, keys: DataFrame, cutoff: float = 92.0, least: int = 6, single: bool = True) -> DataFrame:
    """(word, key, ratio) of all words of at least `least` characters and keys that reach the cutoff (over 0); if single, only keys of one word that differ in length by at most 6.

    A ratio needs cutoff / 200 of both lengths in common characters, and so cutoff / (200 - cutoff) of either
    one. In any order of the characters, here the rare ones first, such a pair shares one among the first
    n - needed + 1 of each: pairs meet there, by an equi-join that loses none.
    """
    if cutoff <= 0:
        raise ValueError("the cutoff must be over 0")
    w = _characters(words.select("word").distinct().where(F.length("word") >= least), "word")
    k = _characters(keys.select("key").distinct().where((F.instr("key", " ") == 0) | F.lit(not single)), "key")
    often = k.select(F.explode("_t").alias("_x")).groupBy("_x").agg(F.count("*").alias("_often"))

    def first(df: DataFrame, name: str, size: str) -> DataFrame:
        needed = F.greatest(F.ceil(F.col("_n") * (cutoff / (200.0 - cutoff)) - 1e-9), F.lit(1))
        rows = df.select(name, F.col("_n").alias(size), needed.alias("_needed"), F.explode("_t").alias("_x")).join(often, "_x", "left")
        order = Window.partitionBy(name).orderBy(F.coalesce("_often", F.lit(0)), "_x")
        return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col(size) - F.col("_needed") + 1).select("_x", name, size)

    j = first(w, "word", "_a").join(first(k, "key", "_b"), "_x").where((F.abs(F.col("_a") - F.col("_b")) <= 6) | F.lit(not single)).select("word", "key").distinct()
    j = j.join(w.select("word", F.col("_n").alias("_a"), F.col("_t").alias("_s")), "word").join(k.select("key", F.col("_n").alias("_b"), "_t"), "key")
    j = j.where(F.size(F.array_intersect("_s", "_t")) >= (F.col("_a") + F.col("_b")) * (cutoff / 200.0) - 1e-9).select("word", "key")
    return j.withColumn("ratio", ratcliff_ratio("word", "key")).where(F.col("ratio") >= cutoff).select("word", "key", "ratio")


# SQL functions by name: arguments, result and body. They call each other, so that no step is computed or written twice.
_SQL = {
    "colour_linear": ("c DOUBLE", "DOUBLE", "CASE WHEN c <= 0.04045 THEN c / 12.92 ELSE power((c + 0.055) / 1.055, 2.4) END"),
    "colour_root": ("t DOUBLE", "DOUBLE", "CASE WHEN t > 216D / 24389 THEN cbrt(t) ELSE t * 841D / 108 + 4D / 29 END"),
    "colour_channel": ("hex STRING, k INT", "DOUBLE", "colour_linear(conv(substring(hex, 2 * k, 2), 16, 10) / 255D)"),
    "colour_lab": ("x DOUBLE, y DOUBLE, z DOUBLE", "STRUCT<L: DOUBLE, a: DOUBLE, b: DOUBLE>", "named_struct('L', 116 * y - 16, 'a', 500 * (x - y), 'b', 200 * (y - z))"),
    "colour_lab_of": (
        "r DOUBLE, g DOUBLE, b DOUBLE", "STRUCT<L: DOUBLE, a: DOUBLE, b: DOUBLE>",
        "colour_lab(colour_root((0.4124564D * r + 0.3575761D * g + 0.1804375D * b) / 0.95047D), colour_root(0.2126729D * r + 0.7151522D * g + 0.0721750D * b), colour_root((0.0193339D * r + 0.1191920D * g + 0.9503041D * b) / 1.08883D))",
    ),
    "hex_to_lab": (
        "hex STRING", "STRUCT<L: DOUBLE, a: DOUBLE, b: DOUBLE>",
        "CASE WHEN hex RLIKE '^#?[0-9A-Fa-f]{6}$' THEN colour_lab_of(colour_channel(concat('#', ltrim('#', hex)), 1), colour_channel(concat('#', ltrim('#', hex)), 2), colour_channel(concat('#', ltrim('#', hex)), 3)) END",
    ),
    "colour_seventh": ("c DOUBLE", "DOUBLE", "sqrt(power(c, 7) / (power(c, 7) + 6103515625D + 1e-12D))"),
    "colour_hue": ("x DOUBLE, b DOUBLE", "DOUBLE", "pmod(degrees(atan2(b, x)), 360D)"),
    "colour_turn": ("d DOUBLE", "DOUBLE", "CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END"),
    "colour_weight": ("h DOUBLE", "DOUBLE", "1 - 0.17D * cos(radians(h - 30)) + 0.24D * cos(radians(2 * h)) + 0.32D * cos(radians(3 * h + 6)) - 0.20D * cos(radians(4 * h - 63))"),
    "colour_sum": ("l DOUBLE, c DOUBLE, h DOUBLE, t DOUBLE", "DOUBLE", "sqrt(l * l + c * c + h * h + t * c * h)"),
    "colour_parts": (
        "l DOUBLE, m DOUBLE, c1 DOUBLE, c2 DOUBLE, cm DOUBLE, d DOUBLE, h DOUBLE", "DOUBLE",
        "colour_sum(l / (1 + 0.015D * m / sqrt(20 + m)), (c1 - c2) / (1 + 0.045D * cm), 2 * sqrt(c1 * c2) * sin(radians(d / 2)) / (1 + 0.015D * cm * colour_weight(h)), -sin(radians(60 * exp(-power((h - 275) / 25, 2)))) * 2 * colour_seventh(cm))",
    ),
    "colour_hues": (
        "l DOUBLE, m DOUBLE, c1 DOUBLE, c2 DOUBLE, h1 DOUBLE, h2 DOUBLE", "DOUBLE",
        "colour_parts(l, m, c1, c2, (c1 + c2) / 2, colour_turn(h1 - h2), pmod((h1 + h2 + CASE WHEN abs(h1 - h2) > 180 THEN 360 ELSE 0 END) / 2, 360D))",
    ),
    "colour_stretched": ("l DOUBLE, m DOUBLE, x1 DOUBLE, b1 DOUBLE, x2 DOUBLE, b2 DOUBLE", "DOUBLE", "colour_hues(l, m, hypot(x1, b1), hypot(x2, b2), colour_hue(x1, b1), colour_hue(x2, b2))"),
    "colour_scaled": ("l DOUBLE, m DOUBLE, a1 DOUBLE, b1 DOUBLE, a2 DOUBLE, b2 DOUBLE, g DOUBLE", "DOUBLE", "colour_stretched(l, m, g * a1, b1, g * a2, b2)"),
    "delta_e00": (
        "L1 DOUBLE, a1 DOUBLE, b1 DOUBLE, L2 DOUBLE, a2 DOUBLE, b2 DOUBLE", "DOUBLE",
        "colour_scaled(L1 - L2, power((L1 + L2) / 2 - 50, 2), a1, b1, a2, b2, 1.5D - 0.5D * colour_seventh((hypot(a1, b1) + hypot(a2, b2)) / 2))",
    ),
}


def register_sql(spark: SparkSession) -> None:
    """hex_to_lab(hex) and delta_e00(L1, a1, b1, L2, a2, b2) as SQL functions, which Catalyst inlines; malformed and NULL values give NULL."""
    for name, (arguments, result, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


def register_polarity(spark: SparkSession, name: str, function) -> None:
    """A pandas UDF (text -> LIKE, DISLIKE or UNKNOWN) as a polarity backend of the session, for use by name."""
    spark.udf.register(f"polarity_{name}", function)


def polarity_by(name: str, text: Column) -> Column:
    """The polarity of a text by a registered backend; whatever else a backend says, and a NULL text, is UNKNOWN."""
    told = F.upper(F.call_function(f"polarity_{name}", text))
    return F.when(told.isin("LIKE", "DISLIKE"), told).otherwise("UNKNOWN")


def register_axis_model(model: DataFrame, name: str) -> None:
    """A table (axis, key: vector) as an axis backend of the session, for use by name."""
    model.select("axis", "key").createOrReplaceTempView(f"axis_model_{name}")


def axes_by(name: str, vectors: DataFrame) -> DataFrame:
    """The axes of vectors (vec_id, embedding) by a registered model."""
    from ..operators.preference import classify_axes

    return classify_axes(vectors, vectors.sparkSession.table(f"axis_model_{name}"))
