"""The registered queries of the corpus operators, one for each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, context_tree, decontaminate, gif, language, lexical_search, minhash_join, mixing, periodic_runs, quality, substring_dedup, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digests(chat.chat_examples(rows))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.fit_grammar(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, grammar).select("doc_id", common.is_held_out(5, 0).alias("held_out"), "score", "predicted")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.minhash_dedup(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify_language(docs, language.fit_language(docs))
    return found.select("doc_id", common.is_held_out(5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model).select("doc_id", common.is_held_out(4, 2).alias("held_out"), "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), with_bytes=False)


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.gif_digests(gif.gif_media(table(spark, sf_dir, "documents")))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.context_tree_scores(table(spark, sf_dir, "documents"))


def _repeating(docs: DataFrame) -> DataFrame:
    """docs with the texts of every tenth document, by crc32 of doc_id, made periodic from some word on."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", F.when(crc % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"))
    docs = docs.select("doc_id", "text", "words", "g", F.size("words").cast("long").alias("n")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_repeating(table(spark, sf_dir, "documents")), with_text=False)
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best).withColumn("runs_sha256", F.sha2(lines, 256))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_chat, op2_toxicity, op3_minhash, op4_decontaminate, op5_language, op6_quality, op7_mixing, op8_suffix, op9_gif, op10_substring, op11_context_tree, op12_runs, op13_search)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_OP1 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v),
t as (select *, row_number() over w as k,
    16 + length(role) + length(text) + (length(text) - length(replace(text, '\', ''))) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, ':', '')))
      - (length(text) - length(replace(text, '###', ''))) // 3 - 5 * ((length(text) - length(replace(text, '</turn>', ''))) // 7)
      - (length(role) - length(replace(role, '###', ''))) // 3 - 5 * ((length(role) - length(replace(role, '</turn>', ''))) // 7) - 2 as chars
  from c window w as (partition by conv_id order by turn nulls first, role, text)),
s as (select *, sum(chars) over (partition by conv_id order by k) as upto, max(k) over (partition by conv_id) as n from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  cast(coalesce(sum(upto) filter (role = 'assistant'), 0) + coalesce(sum(upto) filter (k = n and role <> 'assistant'), 0) as bigint) as formatted_chars
from s group by conv_id
"""

_OP3 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) end as s from w),
n as (select doc_id, len(s) as n from g),
e as (select doc_id, unnest(s) as x from g),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 80 * (na.n + nb.n - i)),
twoway as (select a, b from l union all select b, a from l),
reach as (select doc_id as a, doc_id as b from n union select reach.a, twoway.b from reach join twoway on reach.b = twoway.a)
select n.doc_id, cast(n as bigint) as n_shingles, min(reach.b) as component_id, n.doc_id = min(reach.b) as kept from n join reach on reach.a = n.doc_id group by n.doc_id, n
"""

_OP10 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, i, array_to_string(w[i:i+19], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w where len(w) >= 20)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by x order by doc_id, i) as k from x) where k > 1),
gone as (select doc_id, list(distinct i + j) as gone from r, range(0, 20) t(j) group by doc_id),
k as (select w.doc_id, len(w) as n, case when gone is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]) end as kept from w left join gone on gone.doc_id = w.doc_id)
select doc_id, cast(n as bigint) as n_words, cast(n - len(kept) as bigint) as n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256 from k
"""


_OP12 = r"""
with bytes as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) as h from documents),
g as (select doc_id, w, cast(len(w) as bigint) as n, h, h // 10 as g from bytes),
a as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from g),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
words as (select doc_id, n, case when a is null then w else list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end as w from p),
each as (select doc_id, n, unnest(w) as x, unnest(range(0, n)) as i from words),
pair as (select l.doc_id, r.i - l.i as q, l.i from each l join each r on l.doc_id = r.doc_id and l.x = r.x and r.i > l.i and 3 * (r.i - l.i) <= l.n),
island as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as k from pair),
long as (select doc_id, q, min(i) as s, count(*) + q as length from island group by doc_id, q, k having count(*) + q >= greatest(24, 3 * q)),
runs as (select * from long l where not exists (select 1 from long o where o.doc_id = l.doc_id and o.q < l.q and l.q % o.q = 0 and o.s <= l.s and o.s + o.length >= l.s + l.length)),
line as (select doc_id, count(*) as n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) as lines from runs group by doc_id),
best as (select *, row_number() over (partition by doc_id order by cast(length as double) / q desc, s, q) as k from runs),
gone as (select doc_id, list(distinct i) as gone from (select doc_id, unnest(range(s + q, s + length)) as i from runs) group by doc_id),
kept as (select words.doc_id, array_to_string(case when gone is null then w else list_transform(list_filter(range(0, n), lambda i: not list_contains(gone, i)), lambda i: w[i + 1]) end, ' ') as kept from words left join gone on gone.doc_id = words.doc_id)
select kept.doc_id, coalesce(n_runs, 0) as n_runs, s as start, cast(length as bigint) as length, q as period, cast((1000 * length) // q as bigint) as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from kept left join line on line.doc_id = kept.doc_id left join best on best.doc_id = kept.doc_id and k = 1
"""

_OP13 = r"""
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
total as (select count(*) filter (len(w) > 0) as docs, cast(sum(len(w)) as bigint) as terms from words),
held as (select doc_id, cast(len(w) as bigint) as n, unnest(w) as term from words),
tf as (select doc_id, n, term, count(*) as tf from held group by all),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
weights as (select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by term, docs),
scored as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) as bigint) as score
  from asked join tf using (term) join weights using (term), total group by item_id, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": _OP1, "op3_minhash": _OP3, "op10_substring": _OP10, "op12_runs": _OP12, "op13_search": _OP13}
