"""The corpus pipeline: five stages, each an operator of tessera.llm, from documents to shards.

Every stage takes null values in any column, empty and very long texts, repeated rows and doc_ids, empty tables and columns
of any name; what it does with them is in its docstring. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import latent, line_crf, mixing, partenum, sharding
from tessera.llm.common import stage, unstage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.7 or more. Null and empty texts score 0 and go; equal texts score alike; a null
    doc_id is scored like any other."""
    return line_crf.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard of 0.8 or more, the least doc_id stays.

    Null and empty texts and null doc_ids link with nothing and stay; of rows with equal doc_id one stays."""
    return partenum.keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null and empty texts hold none and stay; with an empty benchmark all stay."""
    return latent.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at most three times; those without words go.

    A null source is one of its own; rows that agree in source, doc_id and size share their copies."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it, along the Hilbert curve; repeated rows each have a place, null text is empty."""
    return sharding.hilbert_shards(docs, shards=24)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: SQL cannot express a fitted classifier or a latent space; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        unstage(before)  # the next one reads what this one wrote
    return STAGES[-1][1](spark, docs, sf_dir)
