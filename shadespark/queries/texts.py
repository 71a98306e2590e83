"""Preference texts: clauses, mentions, polarity, constraints, intents and their thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints as con
from ..operators import preference
from ..sources import fixtures
from ..sources.calibration import LEVELS, THRESHOLDS
from .base import query, with_
from .wishes import CLAUSES, NAMES, POLARITY, REMARK, WISH, aliases, constraint_parts, remarks, texts, tokens


@query(with_(WISH, tokens("(select text_id, text as t from w)", "text_id"), *constraint_parts("text_id"), select="select text_id, axis, direction, strength, evidence from co"))
def txt13_constraints(spark, sf_dir):
    return preference.extract_constraints(texts(spark, sf_dir)).drop("start", "confidence")


@query(with_(WISH, tokens("(select text_id, text as t from w)", "text_id"), select=f"select text_id, word as name, i as start from tok where list_contains({NAMES}, word)"))
def txt3_mentions(spark, sf_dir):
    return preference.mentions(texts(spark, sf_dir), aliases(spark)).select("text_id", "name", "start")


@query(with_(WISH, select=f"select text_id, {POLARITY} as polarity from w"))
def txt6_polarity(spark, sf_dir):
    return texts(spark, sf_dir).select("text_id", preference.polarity(F.col("text")).alias("polarity"))


@query(with_(WISH, CLAUSES, select="select text_id, clause_id, instr(text, clause) - 1 as start, clause, elliptical from cl"))
def txt1_clauses(spark, sf_dir):
    return preference.clauses(texts(spark, sf_dir))


_MENTIONED = (
    tokens("(select text_id, clause_id, clause as t from cl)", "text_id, clause_id"),
    f"me as (select text_id, clause_id, i as start, word as name, elliptical, case when cue <> 'UNKNOWN' then cue when elliptical then 'DISLIKE' else 'UNKNOWN' end as polarity from tok join cl using (text_id, clause_id) where list_contains({NAMES}, word))",
)
_POLAR = """
cp as (select text_id, clause_id, clause, elliptical, case when l and not d then 'LIKE' when d and not l then 'DISLIKE' when cue <> 'UNKNOWN' then cue when elliptical then 'DISLIKE' else 'UNKNOWN' end as polarity from (
  select cl.*, coalesce(l, false) as l, coalesce(d, false) as d from cl left join (select text_id, clause_id, bool_or(polarity = 'LIKE') as l, bool_or(polarity = 'DISLIKE') as d from me group by all) x using (text_id, clause_id)))
"""
_RANK = "case strength when 'strong' then 3 when 'med' then 2 else 1 end"
_RESOLVED = (
    *constraint_parts("text_id, clause_id"),
    f"""mg as (select text_id, clause_id, axis, direction, max(r) as s, min(start) as start, string_agg(evidence, ' / ' order by start) as evidence from (
  select text_id, clause_id, axis, direction, evidence, max({_RANK}) as r, min(start) as start from co group by text_id, clause_id, axis, direction, evidence) group by text_id, clause_id, axis, direction)""",
    """nz as (select mg.*, cp.polarity, case when cp.polarity = 'DISLIKE' and direction = 'raise' then case when contains(lower(evidence), 'too ') then 'cap_guard' else 'invert_dislike_raise' end end as normalised,
  case when cp.polarity = 'DISLIKE' then 'lower' else direction end as d2 from mg join cp using (text_id, clause_id))""",
    """rs as (select text_id, clause_id, start, axis, d2 as direction, case s when 3 then 'strong' when 2 then 'med' else 'weak' end as strength, evidence, polarity, normalised,
  case when row_number() over (partition by text_id, axis order by s desc, clause_id, start) = 1 then 'kept' when count(distinct d2) over (partition by text_id, axis) > 1 then 'conflict' else 'duplicate' end as status from nz)""",
)
_READ = (REMARK, CLAUSES, *_MENTIONED, _POLAR, *_RESOLVED)


def _interpreted(spark, sf_dir):
    return preference.interpreted(remarks(spark, sf_dir), aliases(spark))


@query(with_(*_READ[:4], select="select text_id, clause_id, start, name, polarity from me"))
def txt7_mention_polarity(spark, sf_dir):
    return _interpreted(spark, sf_dir)[1].select("text_id", "clause_id", "start", "name", "polarity")


@query(with_(*_READ[:5], select="select text_id, clause_id, clause, polarity from cp"))
def txt9_clause_polarity(spark, sf_dir):
    return _interpreted(spark, sf_dir)[0].select("text_id", "clause_id", "clause", "polarity")


@query(with_(*_READ[:-2], select="select text_id, clause_id, axis, direction, case s when 3 then 'strong' when 2 then 'med' else 'weak' end as strength, evidence, start from mg"))
def txt16_merge(spark, sf_dir):
    parts = preference.clauses(remarks(spark, sf_dir).select("text_id", preference.plain_not(F.col("text")).alias("text")))
    by = ("text_id", "clause_id")
    return preference.merge_constraints(preference.extract_constraints(parts.select(*by, F.col("clause").alias("text")), by)).drop("confidence")


@query(with_(*_READ, select="select * from rs"))
def txt17_resolved(spark, sf_dir):
    return _interpreted(spark, sf_dir)[2].select("text_id", "clause_id", "start", "axis", "direction", "strength", "evidence", "polarity", "normalised", "status")


@query()
def txt26_interpret(spark, sf_dir):
    return preference.interpret(remarks(spark, sf_dir), aliases(spark))


@query(with_(*_READ, """ar as (select text_id, count(*) filter (status = 'kept') as n_constraints, count(*) filter (status <> 'kept') as n_suppressed from rs group by text_id)""",
    select="""select w.text_id, coalesce(n_clauses, 0) as n_clauses, coalesce(n_mentions, 0) as n_mentions, coalesce(n_constraints, 0) as n_constraints, coalesce(n_suppressed, 0) as n_suppressed from w
  left join (select text_id, count(*) as n_clauses from cl group by text_id) using (text_id) left join (select text_id, count(*) as n_mentions from me group by text_id) using (text_id) left join ar using (text_id)"""))  # fmt: skip
def txt26_sizes(spark, sf_dir):
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    got = preference.interpret(remarks(spark, sf_dir), aliases(spark))
    return got.select("text_id", *(F.when(F.col(c).isNull(), F.lit(0)).otherwise(n(c)).cast("long").alias(f"n_{c}") for c in ("clauses", "mentions", "constraints", "suppressed")))


@query(with_(*_READ[:4], select="""select text_id, '[' || string_agg('{"clause_id":' || clause_id || ',"start":' || start || ',"len":1,"name":"' || name || '","polarity":"' || polarity || '"}', ',' order by clause_id, start) || ']' as mentions from me group by text_id"""))
def fun24_json(spark, sf_dir):
    """The nested output as JSON: here its mentions."""
    got = preference.interpret(remarks(spark, sf_dir), aliases(spark)).where("mentions is not null")
    return got.select("text_id", F.to_json("mentions").alias("mentions"))


_INTENTS = (
    *_READ,
    "pr as (select text_id, clause_id, g, case when count(*) = 1 then any_value(name) end as name from (select *, case polarity when 'LIKE' then 0 when 'DISLIKE' then 2 else 1 end as g from me) group by all)",
    "sf as (select text_id, clause_id, min(g) as g from pr where name is not null group by all)",
    """it as (select rs.text_id, axis, direction, strength, case when rs.polarity <> 'UNKNOWN' then rs.polarity when sf.g is null or sf.g = 0 then 'LIKE' else 'DISLIKE' end as polarity, case when sf.g is null then 'global' else 'target' end as source
  from rs left join sf on sf.text_id = rs.text_id and sf.clause_id = rs.clause_id where status = 'kept')""",
)


def _intents(spark, sf_dir):
    _, found, cons = _interpreted(spark, sf_dir)
    targets = found.select("text_id", "clause_id", "start", (F.col("start") + F.col("len")).alias("stop"), "name", F.lit("color").alias("kind"), "polarity", F.lit(1.0).alias("confidence"))
    return preference.project_axes(targets, cons.where("status = 'kept'"))


@query(with_(*_INTENTS, select="select * from it"))
def txt20_intents(spark, sf_dir):
    return _intents(spark, sf_dir)


_CUT = "case when direction = 'raise' then case strength " + " ".join(f"when '{s}' then {v}" for s, v in preference.RAISE_CUTS.items()) + " end else case " + " ".join(
    f"when axis = '{a}' and strength = '{s}' then {v}" for a, cuts in preference.LOWER_CUTS.items() if a for s, v in cuts.items()
) + " " + " ".join(f"when strength = '{s}' then {v}" for s, v in preference.LOWER_CUTS[""].items()) + " end end"
_DECIDED = (
    "de as (select text_id, axis, score, case when score > 0 then 'raise' when score < 0 then 'lower' end as direction, up, down, has_dislike from (select text_id, axis, sum(case when direction = 'raise' then r else -r end) as score, max(r) filter (direction = 'raise') as up, max(r) filter (direction = 'lower') as down, bool_or(disliked) as has_dislike from vo group by all))",
    "ds as (select text_id, axis, direction, case case when direction = 'raise' then up else down end when 3 then 'strong' when 2 then 'med' else 'weak' end as strength, has_dislike from de where direction is not null)",
    f"th as (select *, cast({_CUT} as double) as cut, case strength when 'strong' then 3.0 when 'med' then 2.0 else 1.0 end * case when has_dislike then 1.5 else 1.0 end as weight from ds)",
)
#: Votes of customers of a nation on axes: more decisions than the texts give, of every strength and direction.
_VOTES = "vo as (select c_custkey // 4 as text_id, (['brightness', 'saturation', 'vibrancy', 'depth', 'clarity'])[c_nationkey % 5 + 1] as axis, case when c_custkey % 3 = 0 then 'raise' else 'lower' end as direction, c_custkey % 7 % 3 + 1 as r, c_custkey % 11 = 0 as disliked from customer)"


def _thresholds(spark, sf_dir):
    k = F.col("c_custkey")
    at = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    votes = fixtures.table(spark, sf_dir, "customer").select(
        F.floor(k / 4).alias("text_id"), at(("brightness", "saturation", "vibrancy", "depth", "clarity"), F.col("c_nationkey") % 5).alias("axis"), F.when(k % 3 == 0, "raise").otherwise("lower").alias("direction"),
        at(("weak", "med", "strong"), k % 7 % 3).alias("strength"), F.when(k % 11 == 0, "DISLIKE").otherwise("LIKE").alias("polarity"),
    )
    return preference.decision_thresholds(preference.merge_intents(votes))


@query(with_(_VOTES, *_DECIDED, select="select text_id, axis, direction, strength, has_dislike, cut, cast(weight as double) as weight from th"))
def txt22_thresholds(spark, sf_dir):
    return _thresholds(spark, sf_dir).select("text_id", "axis", "direction", "strength", "has_dislike", F.col("cut").cast("double").alias("cut"), F.col("weight").cast("double").alias("weight"))


def _level(cuts: dict) -> str:
    """SQL of the level that (dim, direction, cut) snaps to, written out for each dimension."""
    out = []
    for d, v in cuts.items():
        if min(v) >= 0 and max(v) <= 1:
            up = " ".join(f"when {x!r} >= cut then '{n}'" for n, x in zip(LEVELS, v)) + f" else '{LEVELS[-1]}'"
            down = " ".join(f"when {x!r} <= cut then '{n}'" for n, x in reversed(list(zip(LEVELS, v)))) + f" else '{LEVELS[0]}'"
            out.append(f"when dim = '{d}' then case when direction = 'raise' then case {up} end else case {down} end end")
        else:
            out.append(f"when dim = '{d}' then (['low', 'medium', 'high', 'very_high'])[cast(case when direction = 'raise' then ceil(round(cut*3, 9)) else floor(cut*3) end as int) + 1]")
    return "case " + " ".join(out) + " end"


_DIM_OF = "case axis " + " ".join(f"when '{a}' then '{d}'" for a, d in con.AXIS_DIM.items()) + " end"


def _blob_sql(cuts: dict) -> str:
    return with_(
        _VOTES, *_DECIDED, f"dm as (select *, {_DIM_OF} as dim from th)", f"lv as (select *, {_level(cuts)} as level from dm)",
        select="select text_id, string_agg(dim || case direction when 'raise' then '>=' else '<=' end || level || ':' || case when weight = floor(weight) then cast(cast(weight as int) as varchar) else cast(cast(weight as decimal(4,1)) as varchar) end, ';' order by axis) as constraints from lv where level is not null group by text_id",
    )


@query(_blob_sql(THRESHOLDS))
def txt23_blobs(spark, sf_dir):
    return preference.constraint_blobs(_thresholds(spark, sf_dir), THRESHOLDS)


@query(_blob_sql(preference.DEFAULT_CUTS))
def txt23_default_blobs(spark, sf_dir):
    return preference.constraint_blobs(_thresholds(spark, sf_dir))


_STOP = ("not", "but", "the", "and", "for", "that", "want", "give")


def _words(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


@query(with_(
    REMARK.replace("w as (", "w0 as (", 1), "w as (select text_id // 20 as text_id, string_agg(text, '. ' order by text_id) as text from w0 group by 1)", CLAUSES,
    tokens("(select text_id, clause_id, clause as t from cl)", "text_id, clause_id"),
    f"ok as (select text_id, clause_id, i, word from tok where length(word) >= 3 and not regexp_matches(word, '^[0-9]+$') and word not in ('lipstick', 'lipsticks', {', '.join(repr(s) for s in _STOP)}))",
    f"st as (select text_id, word as label, 'GLOBAL' as source, count(*) as n from ok where not list_contains({NAMES}, word) group by all union all select text_id, word, 'ELLIPTICAL_NEG', count(*) from ok join cl using (text_id, clause_id) where elliptical group by all)",
    select="select text_id, label, n, round(n / max(n) over (partition by text_id, source), 9) as strength, source from st where n >= 2"))
def txt24_styles(spark, sf_dir):
    parts = preference.clauses(_joined(spark, sf_dir).select("text_id", preference.plain_not(F.col("text")).alias("text")))
    names = fixtures.anchors(spark).select(F.col("query_id").alias("word"))
    return preference.style_intents(parts, names, _words(spark, _STOP)).withColumn("strength", F.round("strength", 9))


def _joined(spark, sf_dir):
    """The remarks of twenty customers as one text."""
    rows = remarks(spark, sf_dir).groupBy(F.floor(F.col("text_id") / 20).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_id", "text"))), lambda x: x["text"]), ". ").alias("text"))
    return rows.withColumnRenamed("block", "text_id")


@query(with_(
    REMARK, CLAUSES, tokens("(select text_id, clause_id, clause as t from cl)", "text_id, clause_id"),
    f"ok as (select text_id, clause_id, i, word, row_number() over (partition by text_id, word order by clause_id, i) as k from tok join cl using (text_id, clause_id) where elliptical and length(word) >= 3 and not regexp_matches(word, '^[0-9]+$') and word not in ('lipstick', 'lipsticks', {', '.join(repr(s) for s in _STOP)}))",
    select="select text_id, string_agg(word, ' ' order by clause_id, i) as labels from ok where k = 1 group by text_id"))
def txt24_elliptical(spark, sf_dir):
    parts = preference.clauses(remarks(spark, sf_dir).select("text_id", preference.plain_not(F.col("text")).alias("text")))
    return preference.elliptical_labels(parts, _words(spark, _STOP)).withColumn("labels", F.array_join("labels", " "))


@query(with_(*_READ[:4], select="""select text_id, coalesce(string_agg(name, ' ' order by clause_id, start) filter (polarity = 'LIKE'), '') as likes, coalesce(string_agg(name, ' ' order by clause_id, start) filter (polarity = 'DISLIKE'), '') as dislikes
  from me where polarity <> 'UNKNOWN' group by text_id"""))  # fmt: skip
def txt25_taste(spark, sf_dir):
    found = _interpreted(spark, sf_dir)[1].join(F.broadcast(fixtures.anchors(spark).select(F.col("query_id").alias("name"), F.col("anchor_hue").alias("hue_deg"))), "name")
    names = lambda c: F.array_join(F.transform(c, lambda x: x["family"]), " ").alias(c)
    return preference.taste(found).select("text_id", names("likes"), names("dislikes"))


@query("""select l_orderkey as text_id, l_linenumber as n, case l_partkey % 6 when 0 then 'brightness' when 1 then 'saturation' when 2 then 'vibrancy' when 3 then 'depth' when 4 then 'clarity' else 'warmth' end as axis,
  case when l_suppkey % 3 = 0 then 'raise' when l_suppkey % 3 = 1 then 'lower' else case when l_partkey % 6 = 3 then 'raise' else 'lower' end end as direction, case l_suppkey % 5 when 0 then 'weak' when 1 then 'strong' else 'med' end as strength,
  round(least(greatest(l_quantity / 40 - 0.1, 0), 1), 9) as confidence, l_returnflag as evidence from lineitem""")
def txt18_normalise(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    axis = F.element_at(F.array(*map(F.lit, ("brightness", "saturation", "vibrancy", "depth", "clarity", "warmth"))), (p % 6 + 1).cast("int"))
    rows = fixtures.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("text_id"), F.col("l_linenumber").alias("n"), axis.alias("axis"), F.when(s % 3 == 0, "raise").when(s % 3 == 1, "lower").otherwise("sideways").alias("direction"),
        F.when(s % 5 == 0, "weak").when(s % 5 == 1, "strong").when(s % 5 == 2, "huge").alias("strength"), (F.col("l_quantity") / 40 - 0.1).alias("confidence"), F.concat(F.lit("  "), "l_returnflag", F.lit(" ")).alias("evidence"),
    )
    return preference.normalise_constraints(rows).select("text_id", "n", "axis", "direction", "strength", F.round("confidence", 9).alias("confidence"), "evidence")

