"""Scalar shaping functions, vectors, and exact statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAP = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def clamp01(x: Column) -> Column:
    return clip(F.coalesce(x, F.lit(0.0)), 0, 1)


def smoothstep(t: Column) -> Column:
    return t * t * (3 - t * 2)


def sigmoid(z: Column) -> Column:
    """Logistic of z held to -12..12."""
    return 1 / (1 + F.exp(-clip(z, -12, 12)))


def hinge(value: Column, op: Column, threshold: Column) -> Column:
    """How far value is past threshold; 0 where it holds."""
    return F.greatest(F.lit(0.0), F.when(op == "<=", value - threshold).otherwise(threshold - value))


def tilt(value: Column, op: Column, threshold: Column, scale: Column) -> Column:
    return F.tanh(F.when(op == ">=", value / scale - threshold / scale).otherwise(threshold / scale - value / scale))


def softmax2(a: Column, b: Column, temperature: float = 0.08) -> Column:
    """Share of a among two."""
    return 1 / (1 + F.exp((b - a) / temperature))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(a: Column) -> Column:
    """The vector over its length (at least 1e-12)."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)))


def snap(x: Column) -> Column:
    """The nearest of SNAP, the first on ties."""
    grid = F.array(*(F.lit(q) for q in SNAP))
    return F.array_min(F.transform(grid, lambda q: F.struct(F.round(F.abs(q - x), 12).alias("d"), q.alias("q"))))["q"]


def upper_middle(values: Column) -> Column:
    """Index n div 2 of an array's sorted values, without NULLs; NULL if there are none."""
    some = F.array_sort(F.array_compact(values))
    return F.get(some, F.floor(F.size(some) / 2).cast("int"))


def no_nan(x: Column) -> Column:
    return F.nullif(x, F.lit(float("nan")))


def medoid(value: Column, triple: tuple[Column, Column, Column], means: tuple[Column, Column, Column], order: Column) -> Column:
    """The value with the smallest sum of squared distances to the others: the one nearest the mean."""
    d2 = sum((x - m) * (x - m) for x, m in zip(triple, means))
    return F.min_by(value, F.struct(F.round(d2, 9), order))


def circular_mean(h: Column) -> Column:
    """Mean direction in degrees; NULL if there is none."""
    s, c = F.avg(F.sin(F.radians(h))), F.avg(F.cos(F.radians(h)))
    return F.when(F.hypot(s, c) > 1e-12, F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)))
