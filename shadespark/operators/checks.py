"""Checks of schemas and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import SCORING_DIMS
from ..sources.calibration import LEVELS


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def bad_constraints(constraints: DataFrame) -> DataFrame:
    """Constraint rows with a reason to reject them."""
    reason = (
        F.when(~F.col("dim").isin(*SCORING_DIMS), "dim")
        .when(~F.col("op").isin("<=", ">="), "op")
        .when(F.col("cutpoint").isNull() & ~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)), "level")
        .when(F.isnan("cutpoint") | (F.abs("cutpoint") == float("inf")), "cutpoint")
        .when(F.col("weight").isNull() | (F.col("weight") < 0), "weight")
    )
    return constraints.withColumn("reason", reason).where("reason is not null")


def coverage(df: DataFrame, column: str, least: float = 0.95) -> DataFrame:
    """share of rows with the column, and whether it is enough."""
    return df.agg(F.avg(F.col(column).isNotNull().cast("double")).alias("share")).withColumn("enough", F.col("share") >= least)


def training_check(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Whether a feature is missing anywhere, and the labels in order."""
    gaps = [F.max((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")) for c in features]
    return df.agg(F.greatest(*gaps, F.lit(0)).cast("boolean").alias("has_gap"), F.sort_array(F.collect_set(label)).alias("labels"))


def headline(shades: DataFrame, families: str) -> DataFrame:
    """Products, shades and families of a catalogue."""
    return shades.agg(F.countDistinct("product_id").alias("products"), F.countDistinct("product_id", "shade_id").alias("shades"), F.countDistinct(families).alias("families"))
