"""Plans of joins whose sides both grow with the input: nothing of them is broadcast, however well it compresses."""

import pytest
from pyspark.sql import functions as F

from shadespark.operators import constraints, pools, preference, relational
from shadespark.plans import recommend
from shadespark.queries import anchors, wishes
from shadespark.sources import calibration, fixtures, tables

SMALL = "/root/testdata/sf0.001"


def final_plan(df):
    """The plan after the run, as Spark has changed it by the sizes that it met."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_mentions_broadcast_the_lexicon_alone(spark):
    texts = spark.range(2000).select(F.col("id").alias("text_id"), F.lit("I want a red lipstick, not pink").alias("text"))
    plan = final_plan(preference.mentions(texts, wishes.aliases(spark)))
    assert "hashpartitioning(alias" not in plan and plan.count("BroadcastHashJoin") == 1 and "BuildRight" in plan


@pytest.mark.parametrize("at", range(3))
def test_interpreted_tables_are_not_broadcast(spark, at):
    df = preference.interpreted(wishes.remarks(spark, SMALL), wishes.aliases(spark))[at]
    lexicons = 1 if at == 2 else 0  # the axis words
    assert final_plan(df).count("BroadcastHashJoin") == lexicons


def test_interpret_broadcasts_only_lexicons(spark):
    plan = final_plan(preference.interpret(wishes.remarks(spark, SMALL), wishes.aliases(spark)))
    assert "BroadcastHashJoin [text_id" not in plan and "BroadcastHashJoin [clause_id" not in plan


def test_wishes_of_queries_are_not_broadcast(spark):
    queries, cons = recommend.wishes(wishes.texts(spark, SMALL), fixtures.anchors(spark))
    of = recommend.distinct_wishes(tables.stored(queries, "queries"), tables.stored(cons, "constraints"))[1]
    plan = final_plan(of)
    assert "BroadcastHashJoin [query_id" not in plan and plan.count("BroadcastHashJoin") == 1  # the distinct wishes


def test_anchor_grid_broadcasts_only_lexicons(spark):
    assert "BroadcastHashJoin [text_id" not in final_plan(anchors.eva11_anchor_grid(spark, SMALL))


def test_hue_family_keeps_colours_on_its_edge(spark):
    rows = [(b + 15 * k, b + 7 * k + off, b, off) for b in range(20, 190) for k in range(1, 16) for off in (0, 1) if b + 15 * k <= 255]
    pairs = spark.createDataFrame(rows, "r int, g int, b int, off int").selectExpr("*", "1 as query_id", "0d as anchor_hue", "0d as anchor_C")
    got = pools.effective_inventory(pairs, spark.createDataFrame([(1, 0)], "query_id int, n_within int"))
    assert {r["off"]: r["count"] for r in got.groupBy("off").count().collect()} == {0: len(rows) // 2}


def test_equal_constraints_are_snapped_once(spark, monkeypatch):
    """Over one catalogue, twenty queries of two sets of constraints are two states, with the results of each on its own pool."""
    kept, write = [], tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, name: kept.append((name, write(df, name))) or kept[-1][1])
    catalogue = fixtures.shades(spark, SMALL).where("r is not null")
    blobs = spark.range(20).selectExpr("id as query_id", "if(id % 2 = 0, 'light_hsl<=0.05:1;sat_hsl>=0.9:1', 'sat_hsl>=0.95:1;depth>=high:1') as constraints")
    cons = constraints.parse_constraints(blobs)
    got = constraints.snap_cutpoints(catalogue, cons, calibration.calibration(spark), shared=True).collect()
    assert {df.count() for name, df in kept if name == "snap"} <= {1, 2} and len(got) == 40
    each = constraints.snap_cutpoints(catalogue.crossJoin(blobs.select("query_id").where("query_id < 2")), cons.where("query_id < 2"), calibration.calibration(spark)).collect()
    want = {(r["query_id"], r["ord"]): r["cutpoint"] for r in each}
    assert all(r["cutpoint"] == want[r["query_id"] % 2, r["ord"]] for r in got)


def test_neighbours_are_all_pairs_in_reach(spark):
    """A group is compared by stretches: the pairs of brute force, from far fewer rows than all pairs."""
    rows = spark.range(-50, 950).selectExpr("id % 2 as label", "cast(id * 3 / 2 as bigint) as vec_id", "id")
    other = rows.selectExpr("label", "vec_id as variant", "id as other")
    got = relational.neighbours(rows, other, ["label"], "vec_id", "variant", 40)
    want = rows.join(other, "label").where("abs(vec_id - variant) <= 40")
    assert sorted(got.select("id", "other").collect()) == sorted(want.select("id", "other").collect())
    assert "_stretch" in final_plan(got).split("SortMergeJoin")[1].split("]")[0]


def test_wishes_of_families_are_the_broadcast_side(spark):
    from shadespark.queries import ranking

    plan = final_plan(ranking.fam5_factor(spark, SMALL))
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert all("Broadcast" in line and "BuildRight" in line for line in joins[:2]) and "hashpartitioning(p_partkey" in plan


def test_breakdown_is_not_dealt_by_query(spark):
    from shadespark.queries import details

    streamed = final_plan(details.sco7_breakdown(spark, SMALL)).split("BroadcastExchange")[0]
    assert "Join" in streamed and "hashpartitioning(query_id" not in streamed


def test_first_ranks_of_an_inventory_are_those_of_all(spark):
    """With k, the rows of the full ranking: of equal colours, of repeated names, and where shades are fewer than k."""
    df = fixtures.shades(spark, SMALL)
    df = df.unionByName(df.withColumn("shade_id", F.concat("shade_id", F.lit("b")))).unionByName(df.where("shade_id % 3 = 0").withColumns({"product_id": F.lit("A"), "shade_id": F.concat("shade_id", F.lit("c")), "url": F.lit("u"), "shade_name": F.lit("n")}))
    df = tables.stored(df, "twice")
    protos = df.where("r is not null").groupBy(F.col("cluster_id").alias("query_id")).agg(*(F.avg(f"{c}_lab").alias(f"anchor_{c}") for c in "Lab")).where("query_id < 3")
    blobs = spark.createDataFrame([(0, "C_lab<=high:1"), (1, "depth>=high:0.8;warmth<=0.4:1")], "query_id int, constraints string")
    rows = lambda got: sorted((r["query_id"], r["rank"], r["product_id"], r["shade_id"], round(r["score"], 9)) for r in got.collect())
    for shades, k in ((df, 20), (df.limit(12), 20), (df, 1)):
        shades = tables.stored(shades, "some")
        all_ = recommend.score_inventory(shades, protos, blobs, calibration.calibration(spark))
        assert rows(all_.where(F.col("rank") <= k)) == rows(recommend.score_inventory(shades, protos, blobs, calibration.calibration(spark), k=k))


def test_domain_anchors_are_not_dealt_by_word(spark):
    from shadespark.plans import domain

    keys = fixtures.anchors(spark).select(F.col("query_id").alias("key"), F.col("anchor_hue").alias("hue_ref"), F.lit(0).alias("n_text"))
    rows = fixtures.shades(spark, SMALL).where("r is not null").withColumn("hue", F.col("hue_hsl_deg"))
    plan = final_plan(domain.hue_windows(rows, keys))
    assert "SortMergeJoin" not in plan and "BuildLeft" not in plan


def test_label_anchors_are_not_dealt_by_label(spark, monkeypatch):
    """Members are made once for both forms, and no join deals them by label."""
    kept, write = [], tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, name: kept.append(name) or write(df, name))
    base, vivid = anchors._labels(spark, SMALL)
    assert kept == ["naming"]
    assert "SortMergeJoin" not in final_plan(base) + final_plan(vivid)


def test_pixel_medians_of_arrays(spark):
    """As upper_median of single pixels, and without a shuffle."""
    from shadespark.operators import aggregates

    images = spark.createDataFrame([(1, [5, 1, 9, 3]), (2, [4]), (3, [2, None, 8, 6]), (4, []), (5, [None])], "id int, r array<int>")
    got = aggregates.pixel_medians(images, ["r"])
    want = aggregates.upper_median(images.where("id < 5").select("id", F.explode("r").alias("r")), ["id"], ["r"])
    assert {r["id"]: r["r"] for r in got.collect()} == {4: None, 5: None} | {r["id"]: r["r"] for r in want.collect()}
    assert "Exchange" not in final_plan(got)


def test_repeated_names_are_indexed_once(spark, monkeypatch):
    """Rows that repeat change nothing in the index, and are gone before keys are made."""
    from shadespark.plans import assets

    kept, write = {}, tables.stored
    monkeypatch.setattr(assets, "stored", lambda df, name: kept.setdefault(name, write(df, name)))
    rows = [("a", "Deep Red", "#AA0000"), ("b", "deep red", "#aa0000"), ("a", "Red", "#ff0000"), ("a", "Red", "#f00000"), ("c", "red-ish", None)]
    names = spark.createDataFrame(rows * 50, "source string, name string, hex string")
    got = sorted(assets.key_index(names).collect())
    assert kept["keyed"].count() == 4
    kept.clear()
    assert got == sorted(assets.key_index(names.distinct()).collect()) and len(got) == 2


def test_repeated_texts_are_resolved_once(spark, monkeypatch):
    """Queries of one text share its match; none of their ids is broadcast."""
    from shadespark.plans import assets

    kept, write = {}, tables.stored
    monkeypatch.setattr(assets, "stored", lambda df, name: kept.setdefault(name, write(df, name)))
    index = spark.createDataFrame([("red", 3, 3, 3, 0, None), ("dark", 1, 1, 1, 0, None)], "key string, confidence int, n_sources int, n_hex int, n_phrase int, role string")
    asked = ("red", "Reds", "reddish", "dark", "the", "", None)
    queries = spark.range(700).select("id", F.element_at(F.array(*map(F.lit, asked)), (F.col("id") % 7 + 1).cast("int")).alias("text")).toDF("query_id", "text")
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "word string")
    got = assets.resolve(queries, index, words("dark"), words("the"))
    assert "BroadcastHashJoin [query_id" not in final_plan(got) and kept["asked"].count() == 5
    each = {asked[r["query_id"] % 7]: (r["alias"], r["stage"], r["score"]) for r in got.collect()}
    assert each == {"red": ("red", 1, 100.0)} and got.count() == 100


def test_trees_take_tasks_by_rows_not_by_files(spark):
    """Of rows in 40 partitions, a further tree takes few tasks; and trees do not hang on how rows were dealt."""
    from shadespark.plans import learning

    rows = spark.range(1200).selectExpr("cast(id as string) as shade_id", *(f"cast(id * {k * 37 + 11} % 101 as double) as {c}" for k, c in enumerate(learning.FEATURES)))
    rows = tables.stored(rows.withColumn("label", (F.col("L_lab") * 3 + F.col("b_lab") * F.col("C_lab") / 20 > 300).cast("int")), "trees")

    def fit(parts, iterations):
        spark.sparkContext.setJobGroup(group := f"trees-{parts}-{iterations}", group)
        try:
            trees = learning.boosted_ranker(rows.where("shade_id % 5 > 0").repartition(parts), rows.where("shade_id % 5 = 0").repartition(parts), iterations=iterations).stages[-1]
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        status = spark.sparkContext.statusTracker()
        stages = {s for job in status.getJobIdsForGroup(group) for s in status.getJobInfo(job).stageIds}
        return trees.toDebugString, sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))

    (few, less), (many, more), (again, _) = fit(40, 2), fit(40, 6), fit(7, 6)
    assert (more - less) / 4 < 40 and many.split("\n", 1)[1] == again.split("\n", 1)[1]
