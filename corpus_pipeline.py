"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of docs. Tables beside documents (labels, benchmark) are read from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from residua.llm import decontamination, mixing, sharding, simhash, toxicity
from residua.llm._common import durable, let_go, table
from residua.llm.queries import SHARDS, WEIGHTS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3; the model learns from the labels that aren't held out."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity of 0.8 or more of their 5-word shingles."""
    return simhash.keep_one_of_each(docs, words=5, similarity=0.8)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item, exact or edited."""
    return decontamination.drop_copies(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in a global random order."""
    return mixing.mix(docs, WEIGHTS).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard."""
    return sharding.place(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_copies),
    ("mixing to target weights", mix_sources),
    ("sharding", shard),
]

#: A trained model, iterated components and alignments are not for SQL: tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is that of the last."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, durable(stage(spark, docs, sf_dir))
        let_go(before)
    return STAGES[-1][1](spark, docs, sf_dir)
