"""Filters, joins, ranks and set operations over catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color, text
from ..sources.tables import grown

# Fixed words of ineligible products, and of other categories.
INELIGIBLE_WORDS = ("clear", "universal", "recharge", "refill", "echargeable", "rechargeable", "écrin", "ecrin", "étui", "case", "cap", "marbre", "strass")
OTHER_WORDS = ("blush", "joues", "tint")
INELIGIBLE, OTHER_CATEGORY = rf"(?iU)\b({'|'.join(INELIGIBLE_WORDS)})\b", f"(?i)({'|'.join(OTHER_WORDS)})"


def eligible(df: DataFrame) -> DataFrame:
    """Rows whose product and shade names match no ineligible word."""
    return df.where(~F.concat_ws(" ", "product_name", "shade_name").rlike(INELIGIBLE))


def in_category(df: DataFrame) -> DataFrame:
    return df.where(~F.concat_ws(" ", "product_name", "shade_name").rlike(OTHER_CATEGORY))


def with_colour(df: DataFrame) -> DataFrame:
    """Rows with a colour; on the base column, which features derive from."""
    return df.where("r is not null")


def valid_colour(df: DataFrame, hex_: str = "chip_hex", numbers: Sequence[str] = ("L_lab", "C_lab", "H_lab_deg")) -> DataFrame:
    """Rows with six hex digits and finite numbers."""
    ok = F.coalesce(F.col(hex_).rlike("^#[0-9a-fA-F]{6}$"), F.lit(False))
    for c in numbers:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.where(ok)


def concatenated(frames: Sequence[DataFrame], tag: str | None = None) -> DataFrame:
    """The rows of all frames, missing columns NULL; tag names a column with the frame's number."""
    rows = [f.withColumn(tag, F.lit(k)) if tag else f for k, f in enumerate(frames)]
    out = rows[0]
    for f in rows[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def neutral_guard(L: str = "L_lab", a: str = "a_lab", b: str = "b_lab") -> Column:
    """Whether a shade may stand near a neutral anchor (chroma under 18): not nearly white or clear, inside the anchor's box; true for other anchors."""
    near = (F.abs(F.col(L) - F.col("anchor_L")) <= 22) & (F.abs(F.col(a) - F.col("anchor_a")) <= 10) & (F.abs(F.col(b) - F.col("anchor_b")) <= 14)
    return F.when(F.col("anchor_C") < 18, (F.col(L) < 98.5) & (F.hypot(a, b) > 3) & near).otherwise(True)


def in_hue_band(hue: Column, anchor: Column, band: Column) -> Column:
    return color.circ_dist(hue, anchor) <= band


def without_keys(df: DataFrame, denied: DataFrame, key: str) -> DataFrame:
    return df.join(denied.select(key).distinct(), key, "left_anti")


def left_on_best_key(df: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with columns of features on the best key that both have: product and shade, shade, product; features count once for each key."""
    for key in (["product_id", "shade_id"], ["shade_id"], ["product_id"]):
        if all(k in df.columns and k in features.columns for k in key):
            order = Window.partitionBy(*key).orderBy(*(F.col(c).asc_nulls_last() for c in columns))
            one = features.select(*key, *columns).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
            return df.drop(*columns).join(one, key, "left")
    raise ValueError("no common key")


def nearest(df: DataFrame, pivots: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """df with the name of its nearest pivot (squared distance, then name).

    pivots has a bounded number of rows (labels): they become one array literal of the plan, so that
    df is neither joined nor shuffled.
    """
    rows = F.array_sort(F.collect_list(F.struct(name, *columns)))
    near = F.array_min(F.transform("_pivots", lambda p: F.struct(sum((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in columns).alias("d"), p[name].alias("n"))))
    return df.crossJoin(F.broadcast(pivots.agg(rows.alias("_pivots")))).withColumn("nearest", near["n"]).withColumn("d2", near["d"]).drop("_pivots")


def cascade_match(left: DataFrame, right: DataFrame, keys: Sequence[Sequence[str]], value: str, unique_last: bool = True) -> DataFrame:
    """left with value of the first key list that matches right; a key with several rows takes its smallest value, the last key list only unique rows."""
    out, found = left, []
    for k, key in enumerate(keys):
        one = right.groupBy(*(F.col(c).alias(f"_k{k}_{c}") for c in key)).agg(F.min(value).alias(f"_v{k}"), F.count("*").alias(f"_n{k}"))
        if unique_last and k == len(keys) - 1:
            one = one.where(F.col(f"_n{k}") == 1)
        cond = [F.col(c) == F.col(f"_k{k}_{c}") for c in key]
        out = out.join(one, cond, "left").drop(*(f"_k{k}_{c}" for c in key), f"_n{k}")
        found.append(F.col(f"_v{k}"))
    stage = F.coalesce(*(F.when(v.isNotNull(), F.lit(k + 1)) for k, v in enumerate(found)))
    return out.withColumns({value: F.coalesce(*found), "stage": stage}).drop(*(f"_v{k}" for k in range(len(keys))))


def neighbours(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, other: str, reach: int) -> DataFrame:
    """Pairs of rows with equal by whose whole numbers at and other differ by reach at most.

    An equi-join on stretches of 2 * reach + 1 numbers, of which a right row meets two at most, so that a group is never compared as a whole.
    """
    stretch = lambda x: F.floor(x / (2 * reach + 1))
    l = left.withColumn("_stretch", stretch(F.col(at)))
    r = right.withColumn("_stretch", F.explode(F.array_distinct(F.array(stretch(F.col(other) - reach), stretch(F.col(other) + reach)))))
    return l.join(grown(r), [*by, "_stretch"]).where(F.abs(F.col(at) - F.col(other)) <= reach).drop("_stretch")


def word_matches(items: DataFrame, keys: DataFrame, body: str, few: bool = False) -> DataFrame:
    """(items × matching single-word key): an equi-join on words; few keys (a bounded lexicon) are broadcast."""
    words = items.withColumn("key", F.explode(F.array_distinct(text.tokens(F.col(body)))))
    known = keys.select("key").distinct()
    return words.join(F.broadcast(known) if few else known, "key")


def containing_keys(bases: DataFrame, keys: DataFrame) -> DataFrame:
    """(base, key) of multi-word keys that contain a base word."""
    many = keys.select(F.col("key").alias("phrase"), F.explode(F.array_distinct(F.split("key", " "))).alias("key"), F.size(F.split("key", " ")).alias("_n")).where("_n > 1")
    return many.join(bases.select("key").distinct(), "key").select(F.col("key").alias("base"), F.col("phrase").alias("key"))


def display_order(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """df with the preferred columns first, as far as it has them; the others keep their order."""
    return df.select(*(c for c in first if c in df.columns), *(c for c in df.columns if c not in first))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per(df: DataFrame, by: Sequence[str], order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def first_per(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    return top_per(df, by, order, 1, "_n").drop("_n")


def overlay(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several indexes; of equal keys the earlier frame's wins."""
    return first_per(concatenated(frames, "_p"), [key], ["_p"]).drop("_p")


def signature(ranked_: DataFrame, by: str, key: Column, rank: str = "rank") -> DataFrame:
    """The keys of each group in rank order."""
    return ranked_.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), key.alias("k")))), lambda x: x["k"]).alias("keys"))


def with_inventory(top: DataFrame, inventory: DataFrame, keys: Sequence[str], suffix: str = "__inv") -> DataFrame:
    """top with all other columns of the inventory under their name and the suffix; an inventory key counts once, with its smallest row."""
    others = [c for c in inventory.columns if c not in keys]
    one = inventory.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r"))
    return top.join(one, list(keys), "left").select(*top.columns, *(F.col(f"_r.{c}").alias(c + suffix) for c in others))


def attach_features(labels: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """labels with the feature columns on the best key that both have; rows without features go."""
    return left_on_best_key(labels, features, columns).where(" and ".join(f"{c} is not null" for c in columns))


def unique_share(df: DataFrame, column: str) -> DataFrame:
    """n (distinct values), share of them that occur once."""
    each = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    return each.agg(F.count("*").alias("n"), F.avg((F.col("_n") == 1).cast("double")).alias("share"))


def goldens(ranked_: DataFrame, by: str, key: Column, k: int, rank: str = "rank") -> DataFrame:
    """by, keys: the first k keys of each scenario, to be stored and checked against later rankings (golden_check)."""
    return signature(ranked_.where(F.col(rank) <= k), by, key, rank)


def golden_check(golden: DataFrame, got: DataFrame, key: str = "scenario_id") -> DataFrame:
    """key, status: pass, fail, missing golden or missing result."""
    g = golden.select(key, F.col("keys").alias("_g"))
    r = got.select(key, F.col("keys").alias("_r"))
    status = F.when(F.col("_g").isNull(), "missing golden").when(F.col("_r").isNull(), "missing result").when(F.col("_g") == F.col("_r"), "pass").otherwise("fail")
    return g.join(r, key, "full_outer").select(key, status.alias("status"))


def even_picks(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """n rows evenly spaced in an order of a small table (clusters)."""
    w = Window.orderBy(*order)
    total = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(w) - 1
    spots = F.array(*(F.floor(F.lit(i) * (F.col("_t") - 1) / max(n - 1, 1)) for i in range(n)))
    return df.withColumns({"_i": at, "_t": total}).where(F.array_contains(spots, F.col("_i").cast("bigint"))).drop("_i", "_t")


def top_fractions(df: DataFrame, by: str, value: str, key: str, share: float = 0.15, least: int = 50) -> DataFrame:
    """Weak labels: the rows of the largest and the smallest share (half-even, at least 1) of each group of at least `least` rows, as 1 and 0.

    Rows go by value, of equal ones the smaller key first from above; rows without value do not count. Ranks
    are made inside ranges of the value, so that a group is never in one task.
    """
    from .aggregates import offsets, ranged

    binned = ranged(df.where(F.col(value).isNotNull()), [by], value)
    at = offsets(binned, [by], F.count("*"))
    sizes = at.groupBy(by).agg(F.sum("_in").alias("_n")).where(F.col("_n") >= least)
    k = F.greatest(F.bround(F.col("_n") * share).cast("int"), F.lit(1))
    edge = at.join(sizes, by).where((F.col("_before") < k) | (F.col("_before") + F.col("_in") > F.col("_n") - k))
    low = F.row_number().over(Window.partitionBy(by, "_bin").orderBy(value, F.desc(key))) + F.col("_before")
    out = binned.join(edge, [by, "_bin"]).withColumn("_low", low)
    label = F.when(F.col("_low") > F.col("_n") - k, 1).when(F.col("_low") <= k, 0)
    return out.withColumn("label", label).where("label is not null").drop("_n", "_low", "_bin", "_in", "_before")
