"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only its
text is trainable. Turns after the last assistant turn give one example without a target, so that the
output holds every turn. Expansion, template, escaping and reading back are column expressions.

A turn is `### role: text</turn>\\n`. Inside roles and texts, `\\` is written `\\b`, `###` is `\\h`,
`</turn>` is `\\t`, and in roles `:` is `\\c`; every backslash then begins such a pair, so the marks
never occur inside a turn and the change is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ": ", "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for mark, code in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), *([(":", "\\c")] if role else [])):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def unescaped(text: Column, role: bool = False) -> Column:
    for mark, code in (*([(":", "\\c")] if role else []), ("</turn>", "\\t"), ("###", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def chat_examples(conversations: DataFrame) -> DataFrame:
    """Examples: conv_id, example (from 0), n_turns, trainable, prompt, completion.

    prompt + completion is the formatted text; completion is the target's escaped text under the loss
    mask, closed by the end mark outside of it, or empty in an example without a target.

    Rows of a conversation go by turn (nulls first), then role and text, where turns tie; repeated rows are turns of
    their own. Null texts and roles are empty. Rows without conv_id are one conversation. An empty
    table gives no examples. Columns other than conv_id, turn, role and text are not read.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    marked = F.transform("turns", lambda t: F.concat(F.lit(HEAD), escaped(t["role"], True), F.lit(SEP), escaped(t["text"]), F.lit(END)))
    n = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), n), lambda k: (F.element_at("turns", k)["role"] == "assistant"))
    tail = F.when(F.element_at("turns", -1)["role"] != "assistant", F.array(n + 1)).otherwise(F.array().cast("array<int>"))
    one = listed.select("conv_id", "turns", marked.alias("marked"), F.concat(targets, tail).alias("ends")).select("*", F.posexplode("ends").alias("example", "end"))
    trainable = F.col("end") <= n
    head = F.when(trainable, F.concat(F.lit(HEAD), F.lit("assistant"), F.lit(SEP))).otherwise(F.lit(""))
    return one.select(
        "conv_id",
        "example",
        F.when(trainable, F.col("end")).otherwise(n).cast("int").alias("n_turns"),
        trainable.alias("trainable"),
        F.concat(F.array_join(F.slice("marked", F.lit(1), F.col("end") - 1), ""), head).alias("prompt"),
        F.when(trainable, escaped(F.get("turns", F.col("end") - 1)["text"])).otherwise(F.lit("")).alias("completion"),
    )


def formatted() -> Column:
    """The whole text of an example: prompt, completion under the loss mask, end mark."""
    return F.concat("prompt", "completion", F.when(F.col("trainable"), F.lit(END)).otherwise(F.lit("")))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    parts = F.filter(F.split(text, END), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.substring(p, F.lit(len(HEAD) + 1), F.length(p)))
    return F.transform(bare, lambda p: F.struct(unescaped(F.substring_index(p, SEP, 1), True).alias("role"), unescaped(F.substring(p, F.instr(p, SEP) + len(SEP), F.length(p))).alias("text")))


def chat_digests(examples: DataFrame) -> DataFrame:
    """For each conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (over all examples)."""
    full = formatted()
    each = examples.select("conv_id", F.struct("example", full.alias("text")).alias("last"), F.struct("example", F.when(F.col("trainable"), unescaped(F.col("completion"))).otherwise(F.lit("")).alias("loss")).alias("part"), F.length(full).cast("long").alias("chars"))
    got = each.groupBy("conv_id").agg(F.max("last").alias("last"), F.sort_array(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
    got = got.select("conv_id", read_turns(F.col("last.text")).alias("turns"), F.array_join("parts.loss", "").alias("loss"), "formatted_chars")
    content = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(content.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
