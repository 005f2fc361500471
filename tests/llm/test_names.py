"""Documents whose further columns have the names that operators use themselves."""

from llm_fixtures import documents

import corpus_pipeline
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.llm import decontamination, mixing, sharding, similar, texts

NAMES = ["draws", "below", "__own", "__source", "__doc", "__count", "hash", "bits", "one", "n", "n_bytes_", "prefix", "__prefix", "__key", "__key_", "key", "__text", "node", "item_id", "block", "value", "window"]


def named(spark):
    docs = documents(spark, [(i, f"some text number {i} " * 3, f"s{i % 2}") for i in range(20)] + [(None, None), (3, "")])
    return docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in NAMES})


def kept(docs, made):
    """Every row of the result holds the columns of a row of the documents, unchanged."""
    names = docs.columns
    assert made.columns[: len(names)] == names
    assert made.select(*[F.col(f"`{c}`") for c in names]).exceptAll(made.sparkSession.createDataFrame(docs.collect() * 40, docs.schema)).count() == 0
    return made


def test_mixing_and_sharding(spark):
    docs = named(spark)
    mixed = kept(docs, mixing.mix(docs))
    plain = mixing.mix(docs.drop(*NAMES))
    key = ["doc_id", "text", "copy", "position"]
    assert sorted(map(str, mixed.select(key).collect())) == sorted(map(str, plain.select(key).collect()))
    cut = kept(docs, sharding.assign(docs, limit=300))
    key = ["doc_id", "text", "shard", "depth", "n_bytes", "shard_bytes"]
    assert sorted(map(str, cut.select(key).collect())) == sorted(map(str, sharding.assign(docs.drop(*NAMES), limit=300).select(key).collect()))
    assert cut.count() == docs.count()


def test_stages(spark):
    docs = named(spark)
    items = spark.createDataFrame([(1, "some text number 4 some text number 4")], "item_id long, text string")
    assert kept(docs, decontamination.clean(docs, items)).where("doc_id = 4").count() == 0
    assert kept(docs, similar.deduplicated(docs)).count() <= docs.count()
    assert kept(docs, corpus_pipeline.mix_sources(spark, docs, "")).columns == docs.columns
    assert kept(docs, corpus_pipeline.cut_shards(spark, docs, "")).count() == docs.count()


def test_map_texts(spark):
    made = texts.map_texts(named(spark), lambda data, offsets: {"size": (offsets[1:] - offsets[:-1]).tolist()}, [T.StructField("size", T.LongType())])
    assert all(r["size"] == len((r["text"] or "").encode()) and r["__text"].startswith("__text of") for r in made.collect())
