"""The operators as registered queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.llm import (
    conversations, decontamination, divergence, embeddings, language, lattice, mixing, pieces, quality, repeats, sharding, simhash, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query(mixing.mix_sql())
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


@query()
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(load(spark, sf_dir, "embeddings"))


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.held_out(toxicity.score(docs, model, keep=["doc_id"])).select("doc_id", "held_out", "score", "predicted")


@query(sharding.assign_sql())
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "shard", "depth", "n_bytes", "shard_bytes")


@query()
def op5_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(load(spark, sf_dir, "documents"))


@query()
def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.removed(load(spark, sf_dir, "documents")))


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.held_out(quality.score(docs, model, keep=["doc_id"])).select("doc_id", "held_out", "score", "predicted", "n_passages")


@query(decontamination.contaminated_sql())
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "n_windows", "first_word")


@query()
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query()
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language.fit(docs)
    found = language.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return language.held_out(found).select("doc_id", "held_out", "lang_pred", "score", "languages", "proportions")


@query(divergence.audit_sql())
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


@query()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = load(spark, sf_dir, "conversations")
    told, turns = conversations.repaired(conversations.damaged(original), original)
    return conversations.digest(turns, told)


@query()
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.digest(pieces.encode(load(spark, sf_dir, "documents"), model, keep=["doc_id"], decoded="decoded"), ["doc_id"])
