"""The corpus pipeline: toxicity, near duplicates, benchmark passages, mixing, sharding.

Each stage takes the documents that its predecessor kept, as written and read again, and returns documents;
the last one adds each document's shard. Toxic documents, all but one document of each group of near duplicates
and documents with a benchmark passage go; mixing repeats or leaves out documents by the rate of their source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.llm import decontamination, mixing, sharding, similar, toxicity
from sessiongrid.session import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from the labelled ones among them."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    marked = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return toxicity.score(marked, model, keep=["doc"]).where(F.col("predicted") == 0).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    SimHash links first, each checked exactly; then all other pairs with 0.8 or more of their five-word shingles in common.
    """
    return similar.deduplicated(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window similar to a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the rates of their sources, in shuffled order."""
    return mixing.mix(docs).select(*docs.columns)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard they go to."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]
#: the classifier and components of near duplicates cannot be said in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
