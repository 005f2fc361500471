"""Mixing, sharding and decontamination against their SQL, with odd rows and small limits."""

import duckdb
import pytest
from llm_fixtures import SF_DIR, documents
from oracle import connect, difference

from pyspark.sql import functions as F

from sessiongrid.llm import decontamination, mixing, sharding
from sessiongrid.llm.queries import QUERIES, SQL
from sessiongrid.session import new_path


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) is None


def in_duckdb(docs, **tables):
    con = duckdb.connect()
    for name, df in {"documents": docs, **tables}.items():
        con.register(name, df.toArrow())
    return con


def test_mixing_odd_rows(spark, odd_texts):
    docs = documents(spark, [(*t, [None, "a", "b"][i % 3]) for i, t in enumerate(odd_texts)])
    assert difference(mixing.mix(docs), in_duckdb(docs), mixing.mix_sql()) is None
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mixing_meets_weights(spark):
    """Shares of bytes follow the weights; a rate far above MOST_RATE is drawn in parts."""
    docs = documents(spark, [(i, f"text {i:05d}", "big" if i % 200 else "tiny") for i in range(8000)]).withColumn("copy", F.lit("mine"))
    made = mixing.mix(docs, {"big": 1.0, "tiny": 1.0})
    counts = {r.source: r["count"] for r in made.groupBy("source").count().collect()}
    assert abs(counts["tiny"] / 4000 - 1) < 0.1 and abs(counts["big"] / 4000 - 1) < 0.1
    per_doc = [r["count"] for r in made.where("source = 'tiny'").groupBy("doc_id").count().collect()]
    mean = sum(per_doc) / 40
    variance = sum((x - mean) ** 2 for x in per_doc) / 40
    assert 0.4 < variance / mean < 2
    assert mixing.mix(docs, {"big": 1.0}).select("source").distinct().collect()[0].source == "big"
    assert mixing.mix(docs, {}).count() == 0
    again = mixing.mix(docs.repartition(7), {"big": 1.0, "tiny": 1.0})
    assert again.exceptAll(made).count() == 0 and again.count() == made.count()


@pytest.mark.parametrize("limit", [1, 300, 5_000, 1 << 30])
def test_sharding_odd_rows(spark, odd_texts, limit):
    texts = odd_texts + [(i + 100, "abc " * (i % 17)) for i in range(300)] + [(5000, "the same row")] * 400
    docs = documents(spark, texts).repartition(5).withColumn("depth", F.lit("mine"))
    made = sharding.assign(docs, limit).select("doc_id", "shard", "depth", "n_bytes", "shard_bytes")
    assert difference(made, in_duckdb(docs), sharding.assign_sql(limit=limit)) is None
    for r in made.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.first("shard_bytes").alias("s")).collect():
        assert r.b == r.s and (r.b <= limit or r.n == 1 or limit == 1)
    assert sharding.assign(documents(spark, [])).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega end of the item"


def planted(odd_texts):
    words = ITEM.split()
    one_off = " ".join(words[:14] + ["CHANGED"] + words[14:])
    half = " ".join(words[:14])
    return [
        *odd_texts, (100, "before it " + ITEM.upper() + " after it " * 40), (101, ITEM), (102, "x " * 9 + one_off + " y" * 9), (103, "z " + half + " other words follow here"),
        (104, " ".join(words[1:])), (105, (ITEM + " ") * 3), (106, "short item"), (107, "a short item stands here"), (108, "ha ha ha ha ha ha ha ha ha"), (109, "\n".join(words)),
    ]


def test_decontamination_odd_rows(spark, odd_texts):
    items = spark.createDataFrame([(1, ITEM), (2, "short item"), (3, None), (4, ""), (5, "ha ha ha ha ha ha"), (6, ITEM), (1, ITEM)], "item_id long, text string")
    docs = documents(spark, planted(odd_texts)).withColumn("key", F.lit("mine")).withColumn("item_id", F.lit(7))
    found = decontamination.contaminated(docs, items)
    assert difference(found.drop("key"), in_duckdb(docs, benchmark=items), decontamination.contaminated_sql()) is None
    pairs = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {(100, 1), (101, 6), (105, 1), (109, 1), (104, 1), (106, 2), (107, 2), (108, 5)} <= pairs
    assert not {d for d, _ in pairs} & {103, 7, 8, 9, 5}
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in pairs})


def test_decontamination_near_copies(spark):
    """Real items with words changed, dropped or added here and there: every window at 0.8 or more is found."""
    import random

    random.seed(4)
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    texts = []
    for r in items.collect():
        words = r.text.split()
        for edits in (0, 1, 1, 2):
            own = list(words)
            for _ in range(edits):
                at = random.choice([0, 1, len(own) - 2, len(own) - 1, random.randrange(len(own))])
                own[at : at + 1] = random.choice([["other"], [], [own[at], "more"]])
            texts.append("lead in words " + " ".join(own) + " trailing words")
    docs = documents(spark, texts)
    found = decontamination.contaminated(docs, items)
    assert difference(found.drop("key"), in_duckdb(docs, benchmark=items), decontamination.contaminated_sql()) is None
    assert found.select("doc_id").distinct().count() > len(texts) / 2


@pytest.mark.parametrize("n", [1, 2, 3, 40, 999])
def test_wide_lanes_equal_narrow_ones(spark, n):
    import numpy as np

    rows = [(np.random.default_rng([n, k]).integers(-(2**63), 2**63 - 1, n).tolist(),) for k in range(4)] + [([-1] * n,), ([0] * n,)]
    table = spark.createDataFrame(rows, "s array<long>")
    found = table.select(decontamination.simhash(F.col("s"), F.size("s")).alias("narrow"), decontamination.simhash(F.col("s"), F.size("s"), wide=True).alias("wide")).collect()
    expected = [sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in r[0]) > n) for r in rows]
    assert [r.narrow % (1 << 64) for r in found] == expected and [r.wide % (1 << 64) for r in found] == expected


def test_decontamination_items_beyond_a_narrow_lane(spark):
    """An item of more than 16000 words, with repeated shingles, beside a short one, against plain counts."""
    from collections import Counter

    def shingles(own):
        return Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))

    def similarities(text, item):
        own, known = text.split(), item.split()
        for at in range(max(1, len(own) - len(known) + 1)):
            a, b = shingles(own[at : at + len(known)]), shingles(known)
            yield at, (a & b).total() / (a | b).total()

    words = [f"w{i % 15_000}" for i in range(16_500)]
    changed = [f"changed{i}" if i % 400 == 7 else w for i, w in enumerate(words)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, ITEM)], "item_id long, text string")
    docs = documents(spark, [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:9_000])), (4, ITEM + " and more"), (5, "before " + " ".join(words) + " after"), (6, " ".join(words[400:]))])
    found = decontamination.contaminated(docs, items)
    expected = {}
    for d in docs.collect():
        for item in items.collect():
            near = [(at, v) for at, v in similarities(d.text, item.text) if v >= 0.8]
            if near:
                expected[d.doc_id, item.item_id] = (round(max(v for _, v in near), 12), len(near), near[0][0])
    assert {(r.doc_id, r.item_id): (round(r.similarity, 12), r.n_windows, r.first_word) for r in found.collect()} == expected
    assert set(expected) == {(1, 1), (2, 1), (4, 2), (5, 1), (6, 1)}
    assert [r.doc_id for r in decontamination.clean(docs, items).collect()] == [3]


def test_decontamination_empty_tables(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontamination.contaminated(documents(spark, []), items).count() == 0
    assert decontamination.contaminated(documents(spark, [ITEM]), items.limit(0)).count() == 0
    assert decontamination.clean(documents(spark, [ITEM]), items.limit(0)).count() == 1


@pytest.mark.parametrize("name", ["op1_mixing", "op8_decontamination"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_shards_are_written(spark):
    """Each shard is a folder with one file, below the limit, and the folders together hold all rows."""
    docs = documents(spark, [f"text {i} " + "x" * (i % 50) for i in range(400)] + [None, "", "y" * 900, *["same"] * 300]).withColumn("hash", F.lit("mine"))
    path = new_path(spark)
    table = sharding.write(docs, path, limit=600).collect()
    back = spark.read.parquet(path)
    assert len(table) == len({r.shard for r in table}) > 10 and sum(r.documents for r in table) == docs.count()
    large = [r for r in table if r.n_bytes > 600]
    assert [(r.documents, r.n_bytes) for r in large] == [(1, 900)]
    assert back.select("doc_id", "text", "hash").exceptAll(docs.select("doc_id", "text", "hash")).count() == 0 and back.count() == docs.count()
    files = back.select("shard", F.input_file_name().alias("file")).distinct().groupBy("shard").count().collect()
    assert {r["count"] for r in files} == {1}
    assert {r.shard: r.shard_bytes for r in back.collect()} == {r.shard: r.n_bytes for r in table}
    assert sharding.write(docs.limit(0), new_path(spark), limit=600).count() == 0
