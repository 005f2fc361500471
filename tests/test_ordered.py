"""Blocked order operations equal the plain windows, whatever the blocks."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessiongrid.operators.ordered import Blocks, HashBlocks, hash_order, over_neighbours, plan_blocks, row_index, running


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = [(r.choice(["a", "a", "b", None]), r.randint(0, 50) + i * 1e-4, r.choice([None, r.random()]), i) for i in range(300)]
    return spark.createDataFrame(data, "e string, t double, v double, i int").cache()


def table(df):
    return df.toPandas().sort_values("i").reset_index(drop=True)


@pytest.fixture(scope="module", params=[7, 40])
def blocks(request, rows):
    planned = plan_blocks(rows, "t", request.param)
    assert len(planned.cuts) > 3
    return planned


def test_block_numbers_follow_the_order(spark):
    cuts = tuple(float(c) for c in range(100))
    values = spark.createDataFrame([(float(v) / 2,) for v in range(-4, 210)], "v double")
    got = {r.v: r.b for r in values.select("v", Blocks(cuts).number(F.col("v")).alias("b")).collect()}
    assert all(b == sum(c < v for c in cuts) for v, b in got.items())
    few = Blocks(cuts[:5])
    got = {r.v: r.b for r in values.select("v", few.number(F.col("v")).alias("b")).collect()}
    assert all(b == sum(c < v for c in cuts[:5]) for v, b in got.items())


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "timestamp_ntz", "decimal(20,3)", "long", "binary"])
def test_order_columns_of_any_type(spark, kind):
    r = random.Random(8)
    made = {"string": lambda k: f"name, \"{k % 13}\"", "date": lambda k: f"2024-01-{k % 28 + 1:02d}", "binary": lambda k: f"b{k % 17}"}
    text = made.get(kind, (lambda k: f"2024-01-01 00:00:{k % 60:02d}.{k:06d}") if "time" in kind else (lambda k: str(k % 19)))
    data = [(i, None if i % 31 == 0 else text(r.randrange(200))) for i in range(200)]
    df = spark.createDataFrame(data, "i int, o string").withColumn("o", F.col("o").cast(kind))
    planned = plan_blocks(df, ["o", "i"], 9)
    assert len(planned.cuts) > 10
    one = table(row_index(df.select("o", "i"), [], ["o", "i"], blocks=Blocks()))
    two = table(row_index(df.select("o", "i"), [], ["o", "i"], blocks=planned))
    assert (one.idx == two.idx).all()
    sizes = df.select(planned.number(F.col("o"), F.col("i")).alias("b")).groupBy("b").count().collect()
    assert max(s["count"] for s in sizes) < 30


def test_ties_in_the_first_column_split(spark):
    df = spark.range(1000).select((F.col("id") % 10 == 0).cast("double").alias("t"), "id")
    planned = plan_blocks(df, ["t", "id"], 100)
    sizes = [r["count"] for r in df.select(planned.number(F.col("t"), F.col("id")).alias("b")).groupBy("b").count().collect()]
    assert len(sizes) >= 9 and max(sizes) < 300


def test_row_index(rows, blocks):
    one = table(row_index(rows, ["e"], ["t", "i"], blocks=Blocks()))
    two = table(row_index(rows, ["e"], ["t", "i"], blocks=blocks))
    pd.testing.assert_frame_equal(one, two[one.columns])
    assert sorted(one[one.e == "b"].idx) == list(range((one.e == "b").sum()))


def test_row_index_without_keys_by_hash(rows):
    shuffled = rows.withColumn("h", hash_order(3, "i"))
    one = table(row_index(shuffled, [], ["h"], blocks=HashBlocks()))
    two = table(row_index(shuffled, [], ["h"], blocks=HashBlocks(2)))
    assert (one.idx == two.idx).all() and sorted(one.idx) == list(range(300))


@pytest.mark.parametrize("how", ["last", "max", "min", "sum"])
@pytest.mark.parametrize("reverse", [False, True])
def test_running(rows, blocks, how, reverse):
    one = table(running(rows, ["e"], ["t", "i"], F.col("v"), how, "r", Blocks(), reverse))
    two = table(running(rows, ["e"], ["t", "i"], F.col("v"), how, "r", blocks, reverse))
    pd.testing.assert_frame_equal(one, two[one.columns])


@pytest.mark.parametrize("size", [5, 20])
def test_over_neighbours(rows, blocks, size):
    picks = lambda w: {"s": F.sum("i").over(w.rowsBetween(-7, 3)), "p": F.lag("i", 2).over(w)}
    one = table(over_neighbours(rows, ["e"], ["t", "i"], 7, 3, picks, Blocks()))
    two = table(over_neighbours(rows, ["e"], ["t", "i"], 7, 3, picks, blocks, size))
    pd.testing.assert_frame_equal(one, two[one.columns])
