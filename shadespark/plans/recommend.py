"""End to end: a table of wishes against a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import SCORING_DIMS
from ..operators import constraints as con
from ..operators import pools, preference, relational, scoring
from ..sources.tables import grown, stored


ANCHOR = ("anchor_L", "anchor_a", "anchor_b", "anchor_C", "anchor_hue")
#: What a score takes from a shade.
COLOUR = tuple(dict.fromkeys(("L_lab", "a_lab", "b_lab", *SCORING_DIMS)))


def _met(wishes: DataFrame) -> DataFrame:
    """Rows of distinct wishes as the smaller side of a join: broadcast while they are few, so that popular wishes are not one task, else sorted."""
    return F.broadcast(wishes) if wishes.count() <= pools.GROUP_QUERIES else grown(wishes)


def distinct_wishes(queries: DataFrame, constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wishes, of): equal anchors with equal constraints are one wish, named by its smallest query_id; of: query_id, wish_id of every query."""
    c = constraints.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("ord", "dim", "op", "level", "cutpoint", "weight")))).alias("_cons"))
    keyed = queries.select("query_id", *ANCHOR).join(grown(c), "query_id", "left").withColumn("_cons", F.coalesce("_cons", F.lit("")))
    keys = [*ANCHOR, "_cons"]
    wishes = stored(keyed.groupBy(*keys).agg(F.min("query_id").alias("wish_id")), "wishes")
    same = [F.col(f"k.{x}").eqNullSafe(F.col(f"w.{x}")) for x in keys]
    of = keyed.alias("k").join(_met(wishes).alias("w"), same).select("k.query_id", "w.wish_id")
    return wishes.select("wish_id", *ANCHOR, (F.col("_cons") != "").alias("constrained")), of


def recommend(shades: DataFrame, queries: DataFrame, constraints: DataFrame, calibration: DataFrame, k: int = 20, pool_top: int = 1200, lambda_c: float = 2.0) -> DataFrame:
    """The k best shades of every query.

    queries: query_id, anchor_*; constraints: query_id, ord, dim, op, level, cutpoint, weight. Pools hang on the
    anchor and on whether there are constraints, scores on the wish; each is made once and joined to the
    queries in the end, so that the work grows with distinct wishes, and the result with the queries.
    """
    of, best, _ = _recommended(shades, queries, constraints, calibration, k, pool_top, lambda_c)
    return by_query(of, best)


def _recommended(shades, queries, constraints, calibration, k, pool_top, lambda_c) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wishes of queries, recommendations by wish_id, pool traces by wish_id)."""
    wishes, of = distinct_wishes(queries, constraints)
    wishes = wishes.withColumn("pool_id", pool_id())
    plan, pool = anchor_pools(searched(shades), wishes, pool_top)
    trace = wishes.select("wish_id", F.col("pool_id").alias("query_id")).join(plan, "query_id").drop("query_id")
    return of, best_of_wishes(pool, wishes, constraints, calibration, k, lambda_c), trace


def by_query(of: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of every query's wish; of: query_id, wish_id."""
    return of.join(_met(best), "wish_id").drop("wish_id")


def searched(shades: DataFrame) -> DataFrame:
    """The eligible shades with a colour, stored and spread over all tasks."""
    return stored(pools.spread(relational.with_colour(relational.eligible(shades))), "catalogue")


def pool_id() -> Column:
    """The name of a pool: a digest of what it hangs on, the anchor and whether there are constraints."""
    return F.sha2(F.to_json(F.struct(*ANCHOR, "constrained"), {"ignoreNullFields": "false"}), 256)


def anchor_pools(catalogue: DataFrame, wishes: DataFrame, pool_top: int = 1200) -> tuple[DataFrame, DataFrame]:
    """(plan, pool) of the distinct pools that wishes (anchor_*, constrained, pool_id) need, both by query_id: the pool_id."""
    anchors = stored(wishes.select(F.col("pool_id").alias("query_id"), *ANCHOR, "constrained").dropDuplicates(["query_id"]), "anchors")
    plan = stored(pools.pool_plan(catalogue, anchors, pool_top), "pool-plan")
    return plan, stored(pools.candidate_pool(catalogue, anchors, plan, pool_top), "pool")


def answers(pool: DataFrame, wishes: DataFrame, of: DataFrame, constraints: DataFrame, calibration: DataFrame, k: int = 20, lambda_c: float = 2.0) -> DataFrame:
    """The k best shades of every query in of (query_id, wish_id), from stored pools by pool_id; each wish is scored once."""
    return by_query(of, best_of_wishes(pool, wishes, constraints, calibration, k, lambda_c))


def best_of_wishes(pool: DataFrame, wishes: DataFrame, constraints: DataFrame, calibration: DataFrame, k: int = 20, lambda_c: float = 2.0) -> DataFrame:
    """The k best shades of every wish by wish_id, stored; constraints of queries that name no wish are left out."""
    wanted = wishes.select(F.col("pool_id").alias("query_id"), "wish_id")
    each = pool.join(_met(wanted), "query_id").drop("query_id").withColumnRenamed("wish_id", "query_id")
    cons = constraints.join(_met(wishes.select(F.col("wish_id").alias("query_id"))), "query_id", "left_semi")
    numeric = not cons.where("cutpoint is not null").isEmpty()
    scored = scoring.blend(scoring.score(each, cons, calibration, lambda_c=lambda_c, snap=numeric).drop("rank"))
    return stored(scoring.rank_scores(scored, "score_total").where(F.col("rank") <= k), "best").withColumnRenamed("query_id", "wish_id")


def explain(shades: DataFrame, queries: DataFrame, constraints: DataFrame, calibration: DataFrame, k: int = 20, pool_top: int = 1200, lambda_c: float = 2.0) -> DataFrame:
    """recommend with reasons, the pool's trace (min_de, n_within, size_hard, size, thr beside pool_method) and a display order of columns."""
    of, best, trace = _recommended(shades, queries, constraints, calibration, k, pool_top, lambda_c)
    best = best.withColumn("reasons", scoring.explain_flags(F.col("constrained"))).join(trace.select("wish_id", "min_de", "n_within", "size_hard", F.col("size").alias("pool_size"), "thr"), "wish_id")
    out = by_query(of, best)
    return relational.display_order(out, ["query_id", "rank", "brand_name", "shade_name", "score_total", "score", "deltaE", "reasons", "pool_method", "pool_size"])


def score_inventory(shades: DataFrame, prototypes: DataFrame, blobs: DataFrame, calibration: DataFrame, lambda_c: float = 1.0, k: int | None = None) -> DataFrame:
    """Scores of the whole catalogue for constraint strings (query_id, constraints) around prototypes (query_id, anchor_*); with k, the first k ranks of each query alone."""
    cons = con.parse_constraints(blobs)
    numeric = not cons.where("cutpoint is not null").isEmpty()
    catalogue = relational.with_colour(shades)
    if k is not None:
        return _first_of_inventory(catalogue, prototypes, cons, calibration, lambda_c, numeric, k)
    pool = catalogue.crossJoin(F.broadcast(prototypes))  # every shade is scored for every prototype (clusters, a bounded list)
    return scoring.score(pool, cons, calibration, lambda_c=lambda_c, snap=numeric, catalogue=catalogue)


def _first_of_inventory(catalogue, prototypes, cons, calibration, lambda_c, numeric, k) -> DataFrame:
    """The first k ranks of score_inventory. Equal colours have equal scores, so that distinct colours are scored, and only their shades that may be among the first k are ranked.

    Of equal (url, shade_name) one shade ranks. The first shades of these, by id, are told apart: where k colours that have one score
    as much as some bound, at least k ranks do, and no shade below it is among them.
    """
    colour = F.struct(*COLOUR).alias("_colour")
    own = relational.ranked(catalogue.select("url", "shade_name", "product_id", "shade_id", colour), ["url", "shade_name"], ["product_id", "shade_id"], "_n")
    colours = stored(pools.spread(own.groupBy("_colour").agg((F.min("_n") == 1).alias("_first")).select("_colour", "_colour.*", "_first")), "colours")
    scored = scoring.score_rows(colours.crossJoin(F.broadcast(prototypes)), cons, calibration, lambda_c=lambda_c, snap=numeric, catalogue=catalogue)
    best = relational.top_per(scored.where("_first").select("query_id", "score"), ["query_id"], [F.desc_nulls_last("score")], k)
    least = best.groupBy("query_id").agg(F.when(F.count("score") == k, F.min("score")).alias("_least"))
    chosen = scored.drop(*COLOUR, "_first").join(F.broadcast(least), "query_id", "left").where("_least is null or score >= _least").drop("_least")
    rows = catalogue.withColumn("_colour", colour).join(_met(stored(chosen, "chosen")), "_colour").drop("_colour")
    return scoring.rank_scores(rows).where(F.col("rank") <= k)


def wishes(texts: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, constraints) of wish texts (text_id, text): the first colour mention is the anchor, axis words are constraints."""
    aliases = anchors.select(F.col("query_id").alias("alias"), F.col("query_id").alias("name"))
    named = preference.mentions(texts, aliases).groupBy("text_id").agg(F.min_by("name", "start").alias("name"))
    queries = named.join(F.broadcast(anchors.withColumnRenamed("query_id", "name")), "name").withColumnRenamed("text_id", "query_id").drop("name")
    intents = preference.merge_intents(preference.extract_constraints(texts)).where("direction is not null")
    cons = con.from_preferences(intents.withColumnRenamed("text_id", "query_id"))
    cons = relational.ranked(cons, ["query_id"], ["dim", "op"], "ord").select("query_id", "ord", "dim", "op", "level", F.lit(None).cast("double").alias("cutpoint"), "weight")
    return queries, cons
