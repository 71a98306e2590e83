"""Colour joins that skip what is too far away: a catalogue in cells of Lab space, each with a lower bound of CIEDE2000.

A cell has the box of its shades, and for a box and an anchor the parts of the formula have bounds:

* The stretched a* of a pair lies between those of the smallest and the largest mean chroma of the box and the anchor,
  which gives both chromas an interval, and their gap is the least difference in chroma. The weight of chroma grows with the
  mean chroma, the weight of lightness with the distance of the mean lightness from 50.
* A box that is far from the grey axis, by its own diagonal, has its extreme hues at corners. If they do not lie on both
  sides of the anchor's hue, the least difference in hue is that of a corner.
* The factor T of the hue weight is at most its value at the ends of the mean hues plus 2.41 for each radian to the nearer
  end, and never more than 1.93.
* Chroma and hue weigh no more than by the larger of their weights, which is that of chroma, so that the distance in the
  stretched plane gives another bound.
* The rotation term takes off at most half of |R_T| of the sum of both squares; it fades with the distance of the mean hue
  from 275 degrees.

A box keeps all pairs whose bound is within reach, so no pair is lost. Cells of 8-bit colours are at most 15 000.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color

#: Side of a cell in units of L, a and b.
SIDE = 5.0
#: What rounding may take from a bound.
SLACK = 1e-6
LAB = ("L_lab", "a_lab", "b_lab")
ANCHOR = ("anchor_L", "anchor_a", "anchor_b")


def cell() -> Column:
    """The number of a shade's cell."""
    return sum((F.floor(F.col(c) / SIDE).cast("long") + 500) * 1000**k for k, c in enumerate(LAB))


def boxes(shades: DataFrame) -> DataFrame:
    """_cell, the least and largest L, a and b of its shades, and one of them (rep)."""
    s = shades.where("r is not null").withColumn("_cell", cell())
    ends = (f(c).alias(f"_{n}_{c[0]}") for c in LAB for n, f in (("lo", F.min), ("hi", F.max)))
    return s.groupBy("_cell").agg(*ends, F.min(F.struct(*LAB)).alias("rep"))


def _wrapped(x: Column) -> Column:
    return F.pmod(x + 180, F.lit(360.0)) - 180


def _hue_weight(degrees: Column) -> Column:
    at = lambda times, shift: F.cos(F.radians(degrees * times + shift))
    return 1 - at(1, -30) * 0.17 + at(2, 0) * 0.24 + at(3, 6) * 0.32 - at(4, -63) * 0.20


def with_bound(pairs: DataFrame, out: str = "_bound") -> DataFrame:
    """pairs of boxes and anchors with a number that no shade of the box is nearer to the anchor than."""
    c, keep = F.col, pairs.columns
    L, a, b = (c(x) for x in ANCHOR)
    lo, hi = ({n: c(f"_{e}_{n}") for n in "Lab"} for e in ("lo", "hi"))
    p25 = 25.0**7
    inner = lambda n: F.when((lo[n] <= 0) & (hi[n] >= 0), 0.0).otherwise(F.least(F.abs(lo[n]), F.abs(hi[n])))
    outer = lambda n: F.greatest(F.abs(lo[n]), F.abs(hi[n]))
    apart = lambda n, x: F.greatest(F.lit(0.0), lo[n] - x, x - hi[n])
    stretch = lambda chroma: (1 - F.sqrt(F.pow(chroma, F.lit(7.0)) / (F.pow(chroma, F.lit(7.0)) + p25 + 1e-12))) / 2 + 1
    seventh = lambda x: F.pow(x, F.lit(7.0))
    corners = [(x, y, g) for x in (lo["a"], hi["a"]) for y in (lo["b"], hi["b"]) for g in ("_g0", "_g1")]
    hue = lambda x, y: F.degrees(F.atan2(y, x))
    turns = [_wrapped(hue(c(g) * x, y) - hue(c(h) * a, b)) for x, y, g in corners for h in ("_g0", "_g1")]
    middles = [_wrapped(hue(c(h) * a, b) + F.get("_turns", F.lit(k)) / 2 - 275) for k, h in enumerate(["_g0", "_g1"] * len(corners))]
    least = lambda n: F.when((c(f"_{n}0") <= 0) & (c(f"_{n}1") >= 0) & (c(f"_{n}1") - c(f"_{n}0") < 180), 0.0).otherwise(F.array_min(F.transform(f"_{n}", F.abs)))
    ends = lambda n: {f"_{n}0": F.array_min(f"_{n}"), f"_{n}1": F.array_max(f"_{n}")}
    far = F.greatest(F.abs((lo["L"] + L) / 2 - 50), F.abs((hi["L"] + L) / 2 - 50))
    steps = [
        {"_a0": inner("a"), "_a1": outer("a"), "_b0": inner("b"), "_b1": outer("b"), "_far": far * far},
        {"_g1": stretch((F.hypot("_a0", "_b0") + F.hypot(a, b)) / 2), "_g0": stretch((F.hypot("_a1", "_b1") + F.hypot(a, b)) / 2)},
        {"_c0": F.hypot(c("_g0") * c("_a0"), c("_b0")), "_c1": F.hypot(c("_g1") * c("_a1"), c("_b1")), "_d0": F.hypot(c("_g0") * a, b), "_d1": F.hypot(c("_g1") * a, b), "_turns": F.array(*turns)},
        {"_cm": (c("_c1") + c("_d1")) / 2, "_mids": F.array(*middles), "_grey": (c("_c0") <= F.hypot(c("_g1") * (hi["a"] - lo["a"]), hi["b"] - lo["b"])) | (c("_d1") < 1e-9), **ends("turns")},
        {"_turned": c("_turns1") - c("_turns0") >= 180, **ends("mids")},
        {
            "_turn": F.when(c("_grey"), 0.0).otherwise(least("turns")), "_mid": F.when(c("_grey") | c("_turned"), 0.0).otherwise(least("mids")), "_width": c("_mids1") - c("_mids0"),
            "_t": F.greatest(_hue_weight(c("_mids0") + 275), _hue_weight(c("_mids1") + 275)),
        },
        {"_t": F.when(c("_grey") | c("_turned") | (c("_width") >= 180), 1.93).otherwise(F.least(F.lit(1.93), c("_t") + F.radians("_width") * (2.41 / 2))), "_rt": 2 * F.sqrt(seventh(c("_cm")) / (seventh(c("_cm")) + p25)) * F.sin(F.radians(60 * F.exp(-c("_mid") * c("_mid") / 625)))},
        {
            "_l": apart("L", L) / (1 + c("_far") * 0.015 / F.sqrt(c("_far") + 20)),
            "_c": F.greatest(F.lit(0.0), c("_c0") - c("_d1"), c("_d0") - c("_c1")) / (1 + c("_cm") * 0.045),
            "_h": 2 * F.sqrt(c("_c0") * c("_d0")) * F.sin(F.radians(c("_turn") / 2)) / (1 + c("_cm") * c("_t") * 0.015),
            "_p": F.hypot(apart("a", a) * c("_g0"), apart("b", b)) / (1 + c("_cm") * 0.045),
        },
        {out: F.sqrt(c("_l") * c("_l") + (1 - c("_rt") / 2) * F.greatest(c("_c") * c("_c") + c("_h") * c("_h"), c("_p") * c("_p")))},
    ]
    # the explode of one element keeps a later filter from copying the whole formula
    return reduce(lambda df, step: df.withColumns(step), steps, pairs).select(*keep, F.explode(F.array(out)).alias(out))


def reach(boxes_: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """query_id, _reach: within it there are k shades at least (infinite if there are fewer cells): the k-th smallest distance to one shade of each cell."""
    reps = queries.crossJoin(F.broadcast(boxes_.select(*(F.col(f"rep.{c}").alias(c) for c in LAB))))
    d = color.with_delta_e00(reps.select("query_id", *ANCHOR, *LAB), LAB, ANCHOR, "_d").select("query_id", "_d")
    near = d.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("_d"))).where(F.col("_n") <= k)
    return near.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("_d")).otherwise(float("inf")).alias("_reach"))


def near_pairs(shades: DataFrame, queries: DataFrame, limit: Column, boxes_: DataFrame | None = None) -> DataFrame:
    """queries x shades of all cells that may hold a shade within limit (an expression over queries); NULL limits keep all."""
    s = shades.where("r is not null").withColumn("_cell", cell())
    box = (boxes(shades) if boxes_ is None else boxes_).drop("rep")
    bounded = with_bound(queries.withColumn("_limit", F.coalesce(limit.cast("double"), F.lit(float("inf")))).crossJoin(F.broadcast(box)))
    kept = bounded.where(F.col("_bound") <= F.col("_limit") + SLACK).select(*queries.columns, "_cell")
    return s.join(kept, "_cell").drop("_cell")


def near_distances(shades: DataFrame, queries: DataFrame, limit: Column, boxes_: DataFrame | None = None) -> DataFrame:
    """near_pairs with their CIEDE2000 difference, de00: all pairs within limit are among them."""
    return color.with_delta_e00(near_pairs(shades, queries, limit, boxes_), LAB, ANCHOR, "de00")
