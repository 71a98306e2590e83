"""The colour engine: known answers, contracts, and its queries against their SQL."""

import difflib
import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shadespark import queries
from shadespark.functions import color, stats, text, udf
from shadespark.operators import aggregates, cells, checks, constraints, pools, preference, relational, scoring
from shadespark.plans import anchors, assets, domain, learning, reports
from shadespark.sources import calibration, fixtures, tables, web
from shadespark.streaming import jobs

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_delta_e00_known_pairs(spark):
    rows = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492), (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082)]
    df = spark.createDataFrame(rows, "L1 double, a1 double, b1 double, L2 double, a2 double, b2 double, want double")
    for r in color.with_delta_e00(df, ("L1", "a1", "b1"), ("L2", "a2", "b2"), "de").collect():
        assert abs(r["de"] - r["want"]) < 1e-4


def test_hex_and_greys(spark):
    df = spark.createDataFrame([("FF8000",), ("#808080",), ("#12345",), (None,)], "h string").select(color.norm_hex(F.col("h")).alias("h"))
    assert [r["h"] for r in df.collect()] == ["#ff8000", "#808080", None, None]
    hue, sat, light = color.hsl(F.lit(0.5), F.lit(0.5), F.lit(0.5))
    assert spark.range(1).select(hue, sat, light).first()[:] == (0.0, 0.0, 0.5)


def test_preference_contract(spark):
    rows = [(1, "I want a red lipstick but not too bright"), (2, "I want red but not too neon"), (3, "I want red but really not too bright"), (4, "I want a red lipstick"), (5, "I want red and pink"), (6, ""), (7, None)]
    df = spark.createDataFrame(rows, "text_id int, text string")
    got = {r["text_id"]: r for r in preference.extract_constraints(df).collect()}
    assert (got[1]["axis"], got[1]["direction"], got[1]["strength"], got[1]["evidence"]) == ("brightness", "lower", "strong", "not too bright")
    assert got[2]["axis"] == "vibrancy" and got[2]["direction"] == "lower"
    assert "really" not in got[3]["evidence"] and set(got) == {1, 2, 3}
    aliases = spark.createDataFrame([("red", "red"), ("pink", "pink"), ("hot pink", "hot pink")], "alias string, name string")
    many = preference.mentions(spark.createDataFrame([(1, "a hot pink and red one")], "text_id int, text string"), aliases)
    assert [(r["start"], r["name"]) for r in many.orderBy("start").collect()] == [(1, "hot pink"), (4, "red")]


def test_merging_and_conflicts(spark):
    rows = [(1, "depth", "raise", "weak"), (1, "depth", "raise", "med"), (1, "depth", "lower", "strong"), (2, "depth", "raise", "weak")]
    got = {r["text_id"]: r for r in preference.merge_intents(spark.createDataFrame(rows, "text_id int, axis string, direction string, strength string")).collect()}
    assert got[1]["direction"] is None and got[1]["conflict"] and got[2]["direction"] == "raise"
    decisions = spark.createDataFrame([(2, "depth", "raise", "weak", True)], "text_id int, axis string, direction string, strength string, has_dislike boolean")
    assert preference.decision_thresholds(decisions).select("cut", "weight").first()[:] == (0.55, 1.5)
    assert preference.constraint_blobs(preference.decision_thresholds(decisions)).first()["constraints"] == "depth>=high:1.5"
    form = "text_id int, clause_id int, start int, axis string, direction string, strength string, confidence double, evidence string, polarity string"
    rows = [(1, 0, 3, "depth", "raise", "med", 0.5, "deep", "DISLIKE"), (1, 1, 2, "depth", "raise", "strong", 0.4, "too deep", "DISLIKE"), (2, 0, 1, "depth", "raise", "strong", 0.4, "deep", "LIKE"), (2, 1, 1, "depth", "lower", "weak", 0.9, "not deep", "LIKE")]
    got = preference.resolve_conflicts(spark.createDataFrame(rows, form)).collect()
    assert {(r["text_id"], r["direction"], r["normalised"], r["status"]) for r in got} == {(1, "lower", "cap_guard", "kept"), (1, "lower", "invert_dislike_raise", "duplicate"), (2, "raise", None, "kept"), (2, "lower", None, "conflict")}


@pytest.mark.parametrize("dim,op,cut,level", [("light_hsl", ">=", 0.55, "very_high"), ("light_hsl", "<=", 0.46, "low"), ("light_hsl", "<=", 0.47, "medium"), ("light_hsl", "<=", 0.1, "low"), ("light_hsl", ">=", 0.9, "very_high"), ("sat_eff", ">=", 0.5, "high"), ("sat_eff", "<=", 0.5, "medium"), ("sat_eff", "<=", 1.0, "very_high"), ("depth", ">=", 0.0, "low")])
def test_levels_snap_up_for_floors_and_down_for_caps(spark, dim, op, cut, level):
    cuts = F.array(*map(F.lit, calibration.THRESHOLDS[dim]))
    assert spark.range(1).select(preference.snapped_level(F.lit(cut), F.lit(op), cuts)).first()[0] == level


def test_colour_words_resolve_by_stages(spark):
    index = spark.createDataFrame([("red", 4, 4, 9, 12, None), ("crimson", 2, 2, 2, 1, None), ("dark", 1, 1, 1, 2, None), ("light", 3, 3, 3, 9, None), ("nude", 5, 5, 5, 9, "descriptor"), ("burgundy", 1, 1, 1, 1, None), ("hot pink", 1, 1, 1, 0, None)], "key string, confidence int, n_sources int, n_hex int, n_phrase int, role string")
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "word string")
    asked = ["red", "Reddish", "lights", "crimsom", "dark", "light", "nude", "burgundi", "the", "hot-pink", "hot pinks", "xyz", "crim"]
    got = assets.resolve(spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), index, words("dark", "light"), words("the"), single_cutoff=80.0)
    found = {asked[r["query_id"]]: (r["alias"], r["stage"]) for r in got.collect()}
    assert found == {"red": ("red", 1), "lights": ("light", 2), "crimsom": ("crimson", 3), "light": ("light", 1), "hot-pink": ("hot pink", 1), "hot pinks": ("hot pink", 3)}
    made = {r["alias"]: r["key"] for r in assets.derived_aliases(spark.createDataFrame([("reddish",), ("berry",), ("blues",), ("blue",), ("glass",)], "key string")).collect()}
    assert made == {"redd": "reddish"}


@pytest.mark.parametrize("ordered", [None, 10, 200_000])
def test_exact_quantiles_and_weak_labels_equal_plain_ones(spark, monkeypatch, ordered):
    """In one aggregation; over ranges that are cut again down to ten values; over ranges that are cut once."""
    if ordered:
        monkeypatch.setattr(aggregates, "SMALL", 1)
        monkeypatch.setattr(aggregates, "ORDERED", ordered)
    rng = np.random.default_rng(1)
    kinds = {"a": np.array([3.0]), "b": np.array([2.0, -1.0]), "c": np.round(rng.normal(size=777), 1), "d": np.append(rng.normal(size=2000), np.full(1000, 0.5))}
    rows = [(g, float(v)) for g, x in kinds.items() for v in x] + [("c", None), ("e", None)] + [(None, float(k)) for k in range(5)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = (0, 0.05, 0.1, 0.5, 0.9, 0.999, 1)
    got = {r["g"]: (r["n"], r["q"]) for r in aggregates.exact_quantiles(df, ["g"], "v", qs).collect()}
    for g in "abcd":
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g][0] == len(v) and np.allclose(got[g][1], np.quantile(v, qs))
    assert set(got) == {*"abcd", None} and got[None][1][3] == 2.0
    items = [(i % 3, round(float(rng.normal()), 1), f"k{i:04}") for i in range(900)] + [(7, 1.0, "x")]
    labels = {r["k"]: r["label"] for r in relational.top_fractions(spark.createDataFrame(items, "g int, v double, k string"), "g", "v", "k").collect()}
    for g in range(3):
        mine = sorted(((v, k) for c, v, k in items if c == g), key=lambda x: (-x[0], x[1]))
        assert {k for k, n in labels.items() if n == 1 and k in {x[1] for x in mine}} == {k for _, k in mine[:45]}
        assert {k for k, n in labels.items() if n == 0 and k in {x[1] for x in mine}} == {k for _, k in mine[-45:]}
    assert "x" not in labels


def test_many_anchors_meet_the_shades_in_groups(spark, monkeypatch):
    df, anchors = fixtures.shades(spark, SMALL), fixtures.anchors(spark)
    pairs = lambda: {(r["query_id"], r["shade_id"], round(r["de00"], 9)) for r in pools.distances(df, anchors).collect()}
    whole = pairs()
    monkeypatch.setattr(pools, "GROUP_QUERIES", 3)
    monkeypatch.setattr(pools, "SALTS", 4)
    assert pairs() == whole


def test_interpretation_splits_likes_from_dislikes(spark):
    rows = [(1, "I want red but not pink. It is too bright"), (2, "only (not blue) please"), (3, ""), (4, None), (5, "avoid pink; I love a deeper red, less muted")]
    aliases = spark.createDataFrame([(n, n) for n in ("red", "pink", "blue")], "alias string, name string")
    got = {r["text_id"]: r for r in preference.interpret(spark.createDataFrame(rows, "text_id int, text string"), aliases).collect()}
    said = lambda k: [(m["name"], m["polarity"]) for m in got[k]["mentions"] or []]
    assert said(1) == [("red", "LIKE"), ("pink", "DISLIKE")] and said(2) == [("blue", "DISLIKE")] and said(3) == said(4) == []
    assert said(5) == [("pink", "DISLIKE"), ("red", "LIKE")]
    assert [(c["axis"], c["direction"], c["strength"], c["evidence"]) for c in got[1]["constraints"]] == [("brightness", "lower", "strong", "too bright")]
    assert sorted((c["axis"], c["direction"]) for c in got[5]["constraints"]) == [("depth", "raise"), ("saturation", "raise")]
    assert set(got) == {1, 2, 3, 4, 5}


def plain_snap(rows, cons, share=0.05):
    """The relaxed cut-points of (dim, op, cutpoint or None, threshold) constraints, one after the other in up to twelve rounds."""
    thr = [c[3] for c in cons]

    def holds(k, r):
        v = r[cons[k][0]]
        return v is None or (v <= thr[k] if cons[k][1] == "<=" else v >= thr[k])

    for _ in range(12):
        if sum(all(holds(k, r) for k in range(len(cons))) for r in rows) >= share * len(rows):
            break
        moved = False
        for k, (dim, op, cut, _) in enumerate(cons):
            if cut is None:
                continue
            others = [r for r in rows if all(holds(j, r) for j in range(len(cons)) if j != k)] or rows
            v = sorted(r[dim] for r in others if r[dim] is not None)
            if not v:
                continue
            at = (share if op == "<=" else 1 - share) * (len(v) - 1)
            q = v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))
            bounds = calibration.THRESHOLDS[dim]
            new = min(max(thr[k], q), max(bounds)) if op == "<=" else max(min(thr[k], q), min(bounds))
            moved, thr[k] = moved or abs(new - thr[k]) > 1e-12, new
        if not moved:
            break
    return thr


def test_snap_relaxes_numeric_cutpoints(spark):
    """By query and shared: the same as one constraint after the other; queries without cut-points or without rows pass by."""
    shades = tables.stored(fixtures.shades(spark, SMALL).where("r is not null"), "t")
    blobs = ["light_hsl<=0.2:1;sat_hsl>=0.95:1", "light_hsl<=0.9:1;sat_hsl>=0.1:1", "depth>=very_high:1;C_lab<=20:1;L_lab>=90:1", "sat_eff>=high:1", "warmth<=low:1;a_lab>=60:1"]
    cons = constraints.parse_constraints(spark.createDataFrame(list(enumerate(blobs)), "query_id int, constraints string"))
    rows = [r.asDict() for r in shades.select(*color.SCORING_DIMS).collect()]
    want = {}
    for r in cons.collect():
        fixed = r["cutpoint"] if r["cutpoint"] is not None else calibration.THRESHOLDS[r["dim"]][calibration.LEVELS.index(r["level"])]
        want.setdefault(r["query_id"], {})[r["ord"]] = (r["dim"], r["op"], r["cutpoint"], fixed)
    want = {q: plain_snap(rows, [c for _, c in sorted(of.items())]) for q, of in want.items()}
    pool = shades.crossJoin(spark.range(len(blobs)).select(F.col("id").cast("int").alias("query_id")))
    for got in (constraints.snap_cutpoints(shades, cons, calibration.calibration(spark), shared=True), constraints.snap_cutpoints(pool, cons, calibration.calibration(spark))):
        for r in got.collect():
            if r["cutpoint"] is not None:
                assert r["cutpoint"] == pytest.approx(want[r["query_id"]][r["ord"] - 1], abs=1e-9)
    assert constraints.snap_cutpoints(pool.where("query_id > 2"), cons, calibration.calibration(spark)).where("query_id = 0").orderBy("ord").first()["cutpoint"] == 0.2


def test_cells_lose_no_pair_and_compare_few(spark):
    shades = tables.stored(fixtures.shades(spark, "/root/testdata/sf0.01").where("r is not null"), "t")
    grey = spark.createDataFrame([("grey", 50.0, 0.0, 0.0, 0.0), ("blue", 30.0, 60.0, -90.0, 108.2), ("far", 0.0, -100.0, 100.0, 141.4)], "query_id string, anchor_L double, anchor_a double, anchor_b double, anchor_C double")
    anchors = fixtures.anchors(spark).select(*grey.columns).unionByName(grey)
    every = tables.stored(pools.distances(shades, anchors), "every")
    for t, less in ((12, 10), (18, 5), (30, 1)):
        some = tables.stored(cells.near_distances(shades, anchors, F.lit(t)), "some")
        inside = lambda df: sorted(df.where(F.col("de00") <= t).select("query_id", "shade_id").collect())  # noqa: B023, E731
        assert inside(some) == inside(every) and some.count() * less <= every.count()
    assert cells.near_distances(shades, anchors, F.lit(None)).count() == every.count() and cells.near_distances(shades.limit(0), anchors, F.lit(18)).count() == 0
    nearest = {r["query_id"]: r["min_de"] for r in pools.coverage(every).collect()}
    for k in (1, 5):
        for r in cells.reach(cells.boxes(shades), anchors, k).collect():
            assert r["_reach"] >= nearest[r["query_id"]] - 1e-9
    got = {r["query_id"]: r["de00"] for r in pools.within_reach(shades, anchors).groupBy("query_id").agg(F.min("de00").alias("de00")).collect()}
    assert got == pytest.approx(nearest)


def test_pools_over_cells_equal_pools_over_all_pairs(spark, monkeypatch):
    """The ladder's choice and its rows, constrained or not, with an anchor that no shade is near."""
    shades = tables.stored(fixtures.shades(spark, SMALL).where("r is not null"), "t")
    far = fixtures.anchors(spark).where("query_id = 'blue'").withColumns({"query_id": F.lit("far"), "anchor_L": F.lit(0.0), "anchor_a": F.lit(-100.0), "anchor_b": F.lit(100.0)})
    asked = fixtures.anchors(spark).unionByName(far).crossJoin(spark.createDataFrame([(True,), (False,)], "constrained boolean"))
    asked = tables.stored(asked.withColumn("query_id", F.concat_ws(" ", "query_id", F.col("constrained").cast("string"))), "asked")

    def both():
        plan = tables.stored(pools.pool_plan(shades, asked, 100), "plan")
        rows = pools.candidate_pool(shades, asked, plan, 100).select("query_id", "product_id", "shade_id", F.round("de00", 9)).collect()
        near = pools.adaptive_pool(pools.within_reach(shades, asked, k=30), 30).select("query_id", "shade_id").collect()
        return sorted(map(str, plan.withColumn("min_de", F.round("min_de", 9)).collect())), sorted(rows), sorted(near), pools.hard_pool(pools.within_reach(shades, asked, pools.base_threshold(), k=0)).count()

    every = both()
    monkeypatch.setattr(pools, "ALL_PAIRS", 0)
    assert both() == every


def test_bound_of_random_boxes(spark):
    """Boxes of random points and anchors, some on the grey axis: the bound is below every distance."""
    rng = random.Random(4)
    rows = []
    for k in range(300):
        corner, wide = [rng.uniform(0, 95), rng.uniform(-100, 95), rng.uniform(-100, 95)], [rng.uniform(0.1, 12) for _ in range(3)]
        anchor = [corner[i] + rng.gauss(0, 9) for i in range(3)] if k % 3 else [rng.uniform(0, 100), 0.0, 0.0]
        rows += [(k, *anchor, *(corner[i] + rng.random() * wide[i] for i in range(3))) for _ in range(40)]
    points = spark.createDataFrame(rows, "k int, anchor_L double, anchor_a double, anchor_b double, L_lab double, a_lab double, b_lab double")
    box = points.groupBy("k", *cells.ANCHOR).agg(*(f(c).alias(f"_{n}_{c[0]}") for c in cells.LAB for n, f in (("lo", F.min), ("hi", F.max))))
    least = color.with_delta_e00(points, cells.LAB, cells.ANCHOR, "de00").groupBy("k").agg(F.min("de00").alias("de00"))
    assert cells.with_bound(box).join(least, "k").where("_bound > de00 + 1e-9").count() == 0


WEB = "page_id long, url string, html string"


def test_walk_of_embedded_json(spark):
    """Paths of all objects at any depth up to the bound, parents first; texts that look like JSON are texts; broken, empty and missing data have none."""
    deep = "x"
    for k in range(30):
        deep = {"d": deep, "n": k} if k % 2 else [deep]
    data = [{"b": [1, {"z": None}, {"y": "{\"q\": 1}"}], "a": {"name": "n", "brand": {"name": "m"}}}, [], "text", deep]
    script = lambda d: f"<script id='__NEXT_DATA__'>{d if isinstance(d, str) else json.dumps(d)}</script>"
    pages = spark.createDataFrame([(k, "u", script(d)) for k, d in enumerate(data)] + [(10, "u", script("{broken")), (11, "u", ""), (12, None, None)], WEB)
    got = {r["page_id"]: ["/".join(p) for p in r["paths"]] for r in web.walked(pages, depth=40).select("page_id", F.transform("nodes", lambda x: x["path"]).alias("paths")).collect()}

    def plain(v, path=()):
        if isinstance(v, dict):
            yield "/".join(path)
        for k, x in sorted(v.items()) if isinstance(v, dict) else ((f"{i:08d}", x) for i, x in enumerate(v)) if isinstance(v, list) else ():
            yield from plain(x, (*path, k))

    assert {k: got[k] for k in range(4)} == {k: list(plain(d)) for k, d in enumerate(data)} and got[10] == got[11] == got[12] == []
    shallow = web.walked(pages.where("page_id = 3"), depth=4).select(F.size("nodes")).first()[0]
    assert shallow == sum(1 for p in plain(deep) if len([x for x in p.split("/") if x]) <= 4)
    assert web.item_rows(pages).count() == 0 and web.item_rows(pages.limit(0)).count() == 0


def test_family_modes(spark):
    rows = [(1, "P1", "1", "u", "s", 50.0, 10.0, 10.0, 14.1, 45.0, -0.0, 0.5), (1, "P2", "2", "v", "t", 52.0, 10.0, 10.0, 14.1, 45.0, -0.0, 1.0)]
    pool = spark.createDataFrame(rows, "query_id int, product_id string, shade_id string, url string, shade_name string, L_lab double, a_lab double, b_lab double, C_lab double, H_lab_deg double, x double, f double")
    pool = pool.withColumns({d: F.lit(0.5) for d in ("depth", "warmth", "sat_eff", "sat_hsl", "light_hsl", "Y_rel", "colorfulness")} | {"anchor_L": F.lit(40.0), "anchor_a": F.lit(10.0), "anchor_b": F.lit(10.0), "anchor_C": F.lit(14.1)})
    none = spark.createDataFrame([], "query_id int, ord int, dim string, op string, level string, cutpoint double, weight double")
    cal = calibration.calibration(spark)
    plain_ = {r["shade_id"]: r["score"] for r in scoring.score(pool, none, cal, factor="f").collect()}
    fair = {r["shade_id"]: r["score"] for r in scoring.score(pool, none, cal, factor="f", family_mode="penalty").collect()}
    assert plain_["1"] > plain_["2"] * 0.6 and fair["1"] < plain_["1"] < 0


def test_checks_and_text(spark):
    with pytest.raises(ValueError):
        checks.require_columns(spark.range(1), ("x",))
    assert spark.range(1).select(text.variants(F.lit("reddish"))).first()[0] == ["reddish", "redd"]
    assert spark.range(1).select(text.clean_id(F.lit("123.0")), text.clean_id(F.lit("nan"))).first()[:] == ("123", "")
    assert spark.range(1).select(udf.ratcliff_ratio(F.lit("abcd"), F.lit("abcf"))).first()[0] == 75.0
    assert abs(spark.range(1).select(stats.sigmoid(F.lit(100.0))).first()[0] - 1 / (1 + math.exp(-12))) < 1e-12


def test_boosted_ranker_prototypes_and_ordered_predictions(spark, tmp_path):
    df = tables.stored(fixtures.shades(spark, SMALL).where("r is not null"), "learn")
    rows = tables.stored(relational.top_fractions(df, "cluster_id", "C_lab", "shade_id", least=10), "weak")
    model = learning.boosted_ranker(rows.select("product_id", "shade_id", "label", *learning.FEATURES), iterations=3)
    learning.write_predictions(model, rows, str(tmp_path / "p"))
    p = [float(r["p"]) for r in spark.read.option("header", True).csv(str(tmp_path / "p")).collect()]
    assert len(p) == rows.count() and p == sorted(p, reverse=True)
    assert aggregates.auc_ap(learning.predictions(model, rows), "label", "p").first()["auc"] > 0.8
    starts = spark.createDataFrame([(0, 50.0, 40.0, 20.0), (1, 55.0, 12.0, 12.0), (2, -500.0, 0.0, 0.0), (3, 50.0, 40.0, 20.0)], "cluster_id int, L_lab double, a_lab double, b_lab double")
    protos, assigned = assets.prototypes(df, starts)
    assert protos.count() == 4 and assigned.count() == df.count() and protos.agg(F.sum("n")).first()[0] == df.count()
    found = {r["cluster_id"]: r for r in protos.collect()}
    assert found[2]["n"] == 0 and found[2]["L_lab"] == -500  # an empty cluster keeps its centre
    means = assigned.join(df, ["product_id", "shade_id"]).groupBy(assigned.cluster_id).agg(F.avg("L_lab").alias("L")).collect()
    assert all(r["L"] == pytest.approx(found[r["cluster_id"]]["L_lab"]) for r in means) and assets.prototypes(df, starts.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        udf.fuzzy_matches(rows.select(F.col("shade_id").alias("word")), rows.select(F.col("shade_id").alias("key")), 0.0)


def test_stream_keeps_pools_and_repeats_batches(spark, tmp_path):
    """A batch adds the pools of new anchors alone; a repeated one changes neither pools nor answers; texts without a colour have no answer."""
    state, sink = str(tmp_path / "pools"), str(tmp_path / "answers")
    job = jobs.Recommender(fixtures.shades(spark, SMALL), fixtures.anchors(spark), calibration.calibration(spark), state, sink, k=3)
    texts = lambda *rows: spark.createDataFrame(rows, "text_id long, text string")
    batches = [texts((1, "I want a red lipstick"), (2, "I want a pink lipstick")), texts((3, "a red one"), (4, "nothing")), texts((5, "I want coral but not too bright"))]
    for n, b in enumerate(batches):
        job.batch(b, n)
    made = lambda: {d.name: len(spark.read.parquet(str(d)).select("query_id").distinct().collect()) for d in (tmp_path / "pools").iterdir()}
    rows = lambda: sorted(map(str, spark.read.parquet(sink).collect()))
    first, had = rows(), made()
    assert had == {"batch=0": 2, "batch=2": 1} and {r["query_id"] for r in spark.read.parquet(sink).select("query_id").collect()} == {1, 2, 3, 5}
    for n in (0, 1):
        job.batch(batches[n], n)
    assert rows() == first and made() == had


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).cast("int").alias("label"))
    a = learning.stratified_split(df, ["k"])
    assert {(r["label"], r["split"]): r["count"] for r in a.groupBy("label", "split").count().collect()} == {(0, "train"): 350, (0, "valid"): 75, (0, "test"): 75, (1, "train"): 350, (1, "valid"): 75, (1, "test"): 75}
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, learning.stratified_split(df.repartition(7), ["k"]).collect()))


def test_golden_check(spark):
    g = spark.createDataFrame([("a", ["1"]), ("b", ["2"])], "scenario_id string, keys array<string>")
    r = spark.createDataFrame([("a", ["1"]), ("c", ["3"])], "scenario_id string, keys array<string>")
    assert {x["scenario_id"]: x["status"] for x in relational.golden_check(g, r).collect()} == {"a": "pass", "b": "missing result", "c": "missing golden"}


def test_enrich_stream(spark, tmp_path):
    fixtures.raw_items(spark, SMALL).drop("cluster_id").write.json(str(tmp_path / "in"))
    q = jobs.enrich_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == relational.eligible(fixtures.raw_items(spark, SMALL)).count()


def test_targets_ties_and_nulls(spark):
    form = "text_id int, clause_id int, start int, stop int, name string, kind string, polarity string, confidence double"
    rows = [
        (1, 0, 0, 3, "red", "color", "LIKE", 0.9), (1, 0, 4, 7, "pink", "color", "LIKE", 0.85),  # too close: no safe liked target
        (1, 0, 8, 9, "nude", "color", "NEUTRAL", None),
        (2, 0, 0, 3, "red", "color", "DISLIKE", 0.5), (2, 0, 4, 7, "brand", "brand", "DISLIKE", 0.9),
        (3, 0, 0, 3, "red", None, None, None),
    ]
    cons = spark.createDataFrame([(1, 0, "depth"), (2, 0, "depth"), (2, 1, "warmth"), (4, 0, "warmth")], "text_id int, clause_id int, axis string")
    targets, loose = preference.resolve_targets(spark.createDataFrame(rows, form), cons)
    got = {(r["text_id"], r["bucket"], r["name"]): r["n_constraints"] for r in targets.collect()}
    assert got == {(1, "liked", "red"): 0, (1, "liked", "pink"): 0, (1, "disliked", "nude"): 1, (2, "disliked", "red"): 1, (2, "disliked", "brand"): 0}
    assert sorted((r["text_id"], r["axis"]) for r in loose.collect()) == [(2, "warmth"), (4, "warmth")]
    empty, none = preference.resolve_targets(spark.createDataFrame([], form), cons.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_domain_anchors_of_few_shades(spark):
    keys = fixtures.anchors(spark).select(F.col("query_id").alias("key"), F.col("anchor_hue").alias("hue"))
    assert domain.domain_anchors(fixtures.shades(spark, SMALL).limit(20), keys).count() == 0


def test_stabilised_bases(spark):
    grey = [("s", f"pale rose {k}", f"#{90 + k:02x}{88 + k:02x}{86 + k:02x}") for k in range(12)] + [("s", "rose", "#fff5f5")]
    vivid = [("s", f"hot sun {k}", f"#{200 + k:02x}3010") for k in range(10)] + [("s", "sun", "#fffff0")]
    few = [("s", f"dim fog {k}", f"#4040{40 + k:02x}") for k in range(3)] + [("s", "fog", "#eeeeee"), ("s", None, "#000000"), ("s", "ink", "none")]
    names = spark.createDataFrame(grey + vivid + few, "source string, name string, hex string")
    got = {r["key"]: (r["hex"], r["policy"]) for r in anchors.stabilised_bases(assets.key_index(names), names).collect()}
    assert got["fog"] == ("#eeeeee", "own") and set(got) == {"rose", "sun", "fog"}
    assert got["rose"][1] == got["sun"][1] == "variants" and got["rose"][0] in {n[2] for n in grey[:12]} and got["sun"][0] in {n[2] for n in vivid[:10]}


def test_alias_index_rules(spark):
    base = spark.createDataFrame([("Red", "#ff0000"), ("Sky-Blue", "#87ceeb"), ("tan", "#d2b48c")], "name string, hex string")
    extra = spark.createDataFrame([("xkcd:red", "#e50000"), ("xkcd:sky", "#82cafc"), ("xkcd:deep sky", "#0d75f8"), ("xkcd:pale sky", "#bdf6fe"), ("ab", "#010101"), ("odd", "#020202"), (None, "#030303"), ("bad hex", None)], "name string, hex string")
    got = {r["alias"]: (r["source"], r["hex"]) for r in anchors.alias_index(base, extra).collect()}
    assert got["red"] == ("extra", "#e50000") and got["tan"][0] == "base" and got["sky"][0] == "extra" and {"sky blue", "deep sky", "pale sky"} <= set(got)
    assert not {"ab", "odd", ""} & set(got)
    assert anchors.alias_index(base.limit(0), extra.limit(0)).count() == 0


def test_mention_anchors_and_hi_chroma(spark):
    form = "text_id int, start int, name string, kind string, polarity string, confidence double"
    rows = [(1, 0, "rose", "color", "LIKE", 0.4), (1, 3, "ink", "color", None, 0.9), (2, 0, "gone", "color", "LIKE", 0.9), (2, 4, "rose", "color", "NEUTRAL", None), (3, 0, "rose", "color", "DISLIKE", 1.0), (4, 1, "gone", "color", "LIKE", 1.0)]
    candidates = spark.createDataFrame([("rose", 0.90, "#aa8888"), ("rose", 0.88, "#ff0000"), ("rose", 0.5, "#00ff00"), ("ink", None, "#101010")], "name string, score double, hex string")
    got = {r["text_id"]: (r["plain"], r["token"], r["anchor_hex"]) for r in anchors.mention_anchors(spark.createDataFrame(rows, form), candidates).collect()}
    assert got == {1: (False, "rose", "#101010"), 2: (False, "gone", "#ff0000"), 4: (True, "gone", None)}
    cons = spark.createDataFrame([(1, "vibrancy", "raise"), (2, "vibrancy", "raise"), (2, "depth", "lower"), (3, "brightness", "raise"), (4, "brightness", "raise"), (5, "brightness", "lower"), (6, None, None)], "text_id int, axis string, direction string")
    ranked = spark.createDataFrame([(3, "brightness", 0.5), (3, "saturation", 0.48), (4, "brightness", 0.5), (4, "saturation", 0.4)], "text_id int, axis string, score double")
    votes = spark.createDataFrame([(4, "brightness", 0.44), (4, "vibrancy", 0.40)], "text_id int, axis string, score double")
    flags = lambda *s: {r["text_id"] for r in anchors.hi_chroma(cons, *s).collect() if r["hi_chroma"]}
    assert flags() == {1} and flags(ranked) == {1, 3} and flags(ranked, votes) == {1, 3, 4}


def test_axis_gates_and_variants(spark):
    rows = [(1, "depth", 0.9), (1, "warmth", 0.1), (2, "saturation", 0.60), (2, "vibrancy", 0.575), (2, "brightness", 0.571), (3, "saturation", 0.60), (3, "vibrancy", 0.57), (4, "depth", 0.60), (4, "brightness", 0.59), (5, "depth", 0.1), (6, "depth", 0.6), (6, "warmth", 0.55)]
    got = {r["t"]: (r["axis"], r["gate"]) for r in preference.gate_axes(spark.createDataFrame(rows, "t int, axis string, score double"), "t").collect()}
    assert got == {1: ("depth", "strict"), 2: ("brightness", "family_bias_lightness"), 3: ("saturation", "family"), 4: (None, "too_flat"), 5: (None, "min_sim"), 6: (None, "fail_family")}
    v = spark.createDataFrame([("a", "b", [1.0, 0.1]), ("a", "c", [0.0, 1.0]), ("a", "a", [1.0, 0.0])], "label string, variant string, embedding array<double>")
    kept = preference.filter_variants(v, spark.createDataFrame([("a", [1.0, 0.0])], "label string, key array<double>"))
    assert {r["variant"] for r in kept.collect()} == {"a", "b"}


def test_label_anchors_of_few_members(spark):
    long = tables.stored(fixtures.naming_long(fixtures.shades(spark, SMALL)), "few")
    none = spark.createDataFrame([], "label string, hue double")
    assert anchors.label_anchors(long.limit(0), none).count() == 0
    hued = {r["label"]: r["n"] for r in anchors.label_anchors(long, none, 0.9).collect()}
    assert hued and all(n >= 36 for n in hued.values())


def test_neutrality_of_empty_pools(spark):
    top = spark.createDataFrame([], "query_id string, L_lab double, a_lab double, b_lab double, C_lab double, anchor_a double, anchor_b double, low_coverage boolean")
    got = reports.neutrality(top, spark.createDataFrame([(50.0, 10.0)], "L_lab double, C_lab double"), fixtures.anchors(spark)).collect()
    assert len(got) == 17 and all(r["status"] == "EMPTY" and r["failed"] for r in got)


@pytest.mark.parametrize("cutoff", [80.0, 92.0, 55.0])
def test_fuzzy_matches_are_those_of_all_pairs(spark, cutoff):
    rng = random.Random(1)
    known = ["scarlet", "starlet", "purple", "purpl", "rouge", "aaabbb", "bbbaaa", "crème", "fuchsia", "lavender", "red", "navy blue", ""]
    known += ["".join(rng.choices("aabcdeé", k=rng.randint(1, 14))) for _ in range(120)]
    asked = known + ["upurple", "carlet", "fuschia", "lavendre"]
    ratio = lambda a, b: 100 * difflib.SequenceMatcher(None, a, b).ratio()
    want = {(a, b) for a in asked for b in known if len(a) >= 6 and " " not in b and abs(len(a) - len(b)) <= 6 and ratio(a, b) >= cutoff}
    words, keys = (spark.createDataFrame([(x,) for x in xs] + [(None,)], f"{name} string") for xs, name in ((asked, "word"), (known, "key")))
    got = udf.fuzzy_matches(words, keys, cutoff).collect()
    assert {(r["word"], r["key"]) for r in got} == want and len(got) == len(want)
    assert cutoff != 80.0 or {("scarlet", "starlet"), ("purple", "purpl"), ("scarlet", "scarlet")} <= want
