"""Corpus preparation: five stages of the operators in shadespark.llm, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shadespark.llm import common, decontaminate, minhash_join, mixing, substring_dedup, toxicity

#: The columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _one_each(docs: DataFrame) -> DataFrame:
    """One row for each doc_id, the smallest of those that repeat it."""
    return docs.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")


def _kept(docs: DataFrame, verdict: DataFrame, keep) -> DataFrame:
    """The rows of docs for which keep holds, and those without doc_id; verdict has one row for each doc_id."""
    chosen = verdict.where(keep).select(F.col("doc_id").alias("kept_id"))
    known = docs.select(*COLUMNS).join(chosen, F.col("doc_id") == F.col("kept_id"), "left_semi")
    return known.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    grammar = toxicity.fit_grammar(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity_filter(docs.select(*COLUMNS), grammar)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the smallest doc_id."""
    chosen = minhash_join.minhash_dedup(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id"))
    known = docs.select(*COLUMNS).join(chosen, F.col("doc_id") == F.col("kept_id"), "left_semi")
    return _one_each(known).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that start earlier in the corpus go, and documents of which nothing is left."""
    cut = substring_dedup.substring_dedup(docs).where("doc_id is not null and (n_removed = 0 or n_removed < n_words)")
    cut = cut.select(F.col("doc_id").alias("cut_id"), "n_removed", "kept")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    out = docs.select(*COLUMNS).join(cut, F.col("doc_id") == F.col("cut_id"))
    return out.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars")).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go."""
    return _kept(docs, decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), ~F.col("contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: in shards and slots, the words taken of each document, with their text."""
    return mixing.mixed_spans(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("minhash", minhash_stage),
    ("substring", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The learned grammar of the first stage cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
