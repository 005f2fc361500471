"""The pipeline's stages on planted documents, each against an independent look at its own input."""

import pytest
from llm_fixtures import components_of, documents
from test_native import ITEM
from test_similar import share, slow_set

import corpus_pipeline
from pyspark.sql import functions as F

from sessiongrid.llm import decontamination, sharding
from sessiongrid.llm.queries import QUERIES
from sessiongrid.session import settle

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of each stage over real documents with planted ones."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = " ".join(f"quiet{i}" for i in range(80))
    odd = documents(spark, [(90_001, None), (90_002, ""), (90_003, clean), (90_004, clean), (90_004, clean), (90_005, f"before {item} after"), (90_006, "you idiot moron scum clown " * 3 + clean + " " + clean), (None, "no id " + ITEM)])
    docs, out = settle(real.unionByName(odd)), []
    for _, stage in corpus_pipeline.STAGES:
        made = settle(stage(spark, docs, SF))
        out.append((docs, made))
        docs = made
    return out


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes
    assert {"shard", "depth", "shard_bytes"} <= set(stages[-1][1].columns)


def test_toxic_documents_go(stages):
    before, after = stages[0]
    gone = set(ids(before)) - set(ids(after))
    assert 90_006 in gone and not {90_001, 90_002, 90_003, 90_005} & gone and len(gone) < 0.12 * before.count()


def test_one_of_each_group_stays(stages):
    """Of each component of documents with 0.8 or more of their five-word shingles in common the least id stays."""
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    sets = [slow_set(text) for _, text in rows]
    holders = {}
    for i, own in enumerate(sets):
        for shingle in own:
            holders.setdefault(shingle, []).append(i)
    meet = {(i, j) for found in holders.values() for i in found for j in found if j < i}
    meet |= {(i, j) for i in range(len(sets)) for j in range(i) if not sets[i] and not sets[j]}
    pairs = [(i, j) for i, j in meet if share(sets[i], sets[j]) >= 0.8 - 1e-9]
    groups = {}
    for i, root in components_of(range(len(rows)), pairs).items():
        groups.setdefault(root, []).append(rows[i][0])
    assert sum(len(g) > 1 for g in groups.values()) > 3
    assert ids(after) == sorted((min(g, key=lambda v: (v is None, v or 0)) for g in groups.values()), key=str)
    assert ids(after).count(90_003) == 1 and 90_004 not in ids(after) and 90_001 in ids(after) and 90_002 not in ids(after)


def test_benchmark_passages_go(spark, stages):
    before, after = stages[2]
    words = [" ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in before.collect() if any(w and w in " ".join((r.text or "").lower().split()) for w in words)}
    assert leaks and 90_005 in leaks and set(ids(before)) - set(ids(after)) == leaks
    assert decontamination.contaminated(after, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_mixing_repeats_kept_documents(stages):
    before, after = stages[3]
    assert set(ids(after)) <= set(ids(before)) and abs(after.count() - before.count()) < 0.2 * before.count()
    assert after.exceptAll(after.join(before.select("doc_id").distinct(), "doc_id", "left_semi").select(after.columns)).where(F.col("doc_id").isNotNull()).count() == 0


def test_shards_fit(stages):
    before, after = stages[4]
    assert after.select(before.columns).exceptAll(before).count() == 0 and after.count() == before.count()
    sizes = after.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.first("shard_bytes").alias("s")).collect()
    assert all(r.b == r.s <= sharding.LIMIT for r in sizes) and len(sizes) > 1


def test_run_is_registered(spark):
    assert QUERIES and corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
