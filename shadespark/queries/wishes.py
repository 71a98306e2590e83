"""Preference texts and the SQL that reads them word by word."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preference
from ..sources import fixtures

NAMES = "[" + ", ".join(f"'{n}'" for n, _ in fixtures.ANCHORS) + "]"
FORMS = ("I want a {c} lipstick", "I want {c} lipstick", "Looking for a {c} shade", "Give me a {c} lip color")
TAILS = ("", " but not too bright", ", not neon", " but really not too bright", " that is darker")
REMARKS = (
    "", " but not {d}", ", not neon", ". I prefer it less muted, without {d}", " (not {d}) and not too bright", "; avoid {d}: it is too dark and dusty", " that is darker. Not {d}.",
    " or {d}. More saturated and dim!", "\nno {d}, please; deeper is fine",
)


def _sql_list(texts: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for t in texts) + "]"


def _built(tails: tuple[str, ...]) -> str:
    return f"""w as (select c_custkey as text_id, replace(replace(({_sql_list(FORMS)})[c_custkey % 4 + 1], '{{c}}', ({NAMES})[c_custkey % 17 + 1])
  || ({_sql_list(tails)})[c_custkey % {len(tails)} + 1], '{{d}}', ({NAMES})[c_nationkey % 17 + 1]) as text from customer)"""


#: w: text_id, text of the wishes; R: of the remarks.
WISH, REMARK = _built(TAILS), _built(REMARKS)


def _texts(spark, sf_dir, tails):
    at = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    names, k = tuple(a[0] for a in fixtures.ANCHORS), F.col("c_custkey")
    text = F.replace(F.concat(F.replace(at(FORMS, k), F.lit("{c}"), at(names, k)), at(tails, k)), F.lit("{d}"), at(names, F.col("c_nationkey")))
    return fixtures.table(spark, sf_dir, "customer").select(k.alias("text_id"), text.alias("text"))


def texts(spark, sf_dir):
    """Wishes of customers: a colour and at most one axis word."""
    return _texts(spark, sf_dir, TAILS)


def remarks(spark, sf_dir):
    """Longer texts with several clauses, liked and disliked colours and axis words."""
    return _texts(spark, sf_dir, REMARKS)


def aliases(spark):
    return fixtures.anchors(spark).select(F.col("query_id").alias("alias"), F.col("query_id").alias("name"))


_EDGE = r"[\s,.;:!?()]"


def _cue(column: str) -> str:
    has = lambda cues: f"regexp_matches(lower({column}), '(^|{_EDGE})({'|'.join(c.replace(chr(39), chr(39) * 2) for c in cues)})($|{_EDGE})')"
    neg, pos = has(preference.NEGATIVE_CUES), has(preference.POSITIVE_CUES)
    return f"case when {neg} and not {pos} then 'DISLIKE' when {pos} and not {neg} then 'LIKE' else 'UNKNOWN' end"


POLARITY = _cue("text")

#: cl: text_id, clause_id, clause, elliptical, cue of the texts in w.
CLAUSES = rf"""
pn as (select text_id, regexp_replace(text, '\s*\(not ([^)]*)\)', ', not \1', 'g') as text from w),
s1 as (select text_id, text, regexp_replace(regexp_replace(text, '[.!?;:\n]+|,?\s+but\s+', chr(1), 'g'), '(,\s+|\s+and\s+|\()((not|no|without)\b)', chr(1) || '\2', 'g') as m from pn),
s2 as (select text_id, text, unnest(string_split(m, chr(1))) as p, generate_subscripts(string_split(m, chr(1)), 1) as k from s1),
cl as (select text_id, text, row_number() over (partition by text_id order by k) - 1 as clause_id, trim(p, ' ') as clause, regexp_matches(lower(trim(p, ' ')), '^(but )?(not|no) ') as elliptical, {_cue("trim(p, ' ')")} as cue from s2 where length(trim(p, ' ')) >= 2)
"""


def tokens(source: str, keys: str) -> str:
    """tok: keys, word, i (from 0) of the texts (column t) of a source."""
    return f"tok as (select {keys}, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from (select {keys}, list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as ws from {source}))"


_LEX = ", ".join(f"('{w}', '{a}', '{d}', {str(c).lower()})" for w, a, d, c in preference.axis_lexicon())
_NEG = ", ".join(f"'{w}'" for w in preference.NEGATIONS)


def constraint_parts(keys: str) -> tuple[str, ...]:
    """co: keys, start, axis, direction, strength, evidence of the words in tok."""
    on = " and ".join(f"h.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    h = ", ".join(f"h.{k.strip()}" for k in keys.split(","))
    return (
        f"lex as (select * from (values {_LEX}) v(word, axis, base, compared))",
        f"""cu as (select {h}, h.i, h.word, axis, base, compared, c.i as ci, c.word as cw, case when c.word in ({_NEG}) then 'neg' else c.word end as kind from tok h join lex using (word)
  left join tok c on {on} and c.i < h.i and ((c.word in ('too', 'more', 'less') and c.i >= h.i - 4) or (c.word in ({_NEG}) and c.i >= h.i - 3)))""",
        f"""cx as (select {keys}, i, word, any_value(axis) as axis, any_value(base) as base, any_value(compared) as compared, arg_min(kind, ci) filter (kind <> 'neg') as degree, coalesce(bool_or(kind = 'neg'), false) as neg, string_agg(cw, ' ' order by ci) as cws from cu group by {keys}, i, word)""",
        f"""co as (select {keys}, i as start, axis, case when degree = 'more' then base when degree is not null or neg then case base when 'raise' then 'lower' else 'raise' end else base end as direction,
  case when neg or compared or degree is not null then 'strong' else 'weak' end as strength, coalesce(cws || ' ', '') || word as evidence from cx)""",
    )
