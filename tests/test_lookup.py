"""The broadcast index against the ordered passes and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sessiongrid.operators import asof, intervals, lookup


@pytest.fixture(scope="module")
def spans(spark):
    draw = random.Random(11)
    rows = [(draw.choice(["a", "b", None]), s, s + draw.choice([0, 0, 1, 5, 20, -1]), k, f"w{k}") for k in range(120) for s in [draw.randint(0, 50)]]
    rows += [("a", None, 5, 200, "x"), ("a", 5, None, 201, "x"), ("b", 3, 60, None, "never"), ("lonely", 7, 9, 1, None)]
    return spark.createDataFrame(rows, "e string, start int, end int, k int, word string").cache()


@pytest.fixture(scope="module")
def points(spark):
    rows = [(e, p / 2.0) for e in ("a", "b", "c", None, "lonely") for p in range(-2, 150)] + [("a", None), (None, None)]
    return spark.createDataFrame(rows, "e string, t double").withColumns({"_times": F.lit(1), "_key0": F.lit("a")}).drop("_times", "_key0").cache()


def both(make):
    found = [sorted(map(str, make(index).collect())) for index in (True, False)]
    assert found[0] == found[1] and found[0]
    return found[0]


@pytest.mark.parametrize("pick", ["first", "last"])
def test_lookup_equals_pass(spans, points, pick):
    every = spans.collect()
    named = [df.where("e IS NOT NULL") for df in (points, spans)]  # the pass joins by key, so a null key is none there
    both(lambda index: intervals.lookup_interval(*named, ["e"], "t", "start", "end", "k", ["word"], pick, index=index))
    for r in intervals.lookup_interval(points, spans, ["e"], "t", "start", "end", "k", ["word", "k"], pick, index=True).collect():
        held = [s.k for s in every if s.e == r.e and None not in (s.start, s.end, s.k, r.t) and s.start <= r.t <= s.end]
        assert r.k == ((min(held) if pick == "first" else max(held)) if held else None)


@pytest.mark.parametrize("half_open", [False, True])
def test_containment_equals_pass(spans, points, half_open):
    wide = points.withColumn("t2", F.col("t") + 1.5)
    both(lambda index: intervals.mark_contained(wide, spans, ["e"], "t", "t2", half_open=half_open, index=index))


def test_labels_equal_pass(spark, points):
    chain = spark.createDataFrame([(e, k, b, c) for e in ("a", None) for k, (b, c) in enumerate([(1, 4), (4, 4), (4, 9), (12, 20), (20, 21)], 1)], "e string, k int, start int, end int")
    labels = both(lambda index: intervals.multiclass_label(points, chain, ["e"], "t", index=index))
    assert any("multiclass_label=4" in r for r in labels)
    both(lambda index: intervals.binary_label(points, chain, ["e"], "t", index=index))
    both(lambda index: intervals.mask_intervals(points, chain, ["e"], "t", index=index))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_pass(spans, points, direction, strict):
    right = spans.select("e", F.col("start").alias("at"), F.col("k").alias("hit"))
    both(lambda index: asof.asof_join(points, right, ["e"], "t", "at", ["hit"], direction, strict, "hit", index=index))


def test_two_keys_and_timestamps(spark):
    left = spark.sql("SELECT id % 3 AS e, id % 2 AS f, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS t FROM range(90)")
    right = spark.sql("SELECT id % 3 AS e, id % 2 AS f, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 7) AS at, array(id, id + 1) AS hit FROM range(12)")
    both(lambda index: asof.asof_join(left, right, ["e", "f"], "t", "at", ["hit"], index=index))
    spans = right.withColumns({"end": F.col("at") + F.expr("interval 9 seconds"), "k": F.get("hit", 0)})
    both(lambda index: intervals.lookup_interval(left, spans, ["e", "f"], "t", "at", "end", "k", ["hit"], index=index))


def test_points_are_not_shuffled(spark, points, spans):
    """No exchange and no window lies between the points and the result."""
    made = [
        intervals.binary_label(points, spans, ["e"], "t"), intervals.lookup_interval(points, spans, ["e"], "t", "start", "end", "k", ["word"]),
        asof.asof_join(points, spans.select("e", F.col("start").alias("at"), F.col("k").alias("hit")), ["e"], "t", "at", ["hit"]),
    ]
    for df in made:
        plan = df._jdf.queryExecution().sparkPlan().toString().split("\n")  # before exchanges are put in
        join = next(i for i, line in enumerate(plan) if "BroadcastHashJoin" in line)
        depth = len(plan[join]) - len(plan[join].lstrip(" :+-"))
        left = [line for line in plan[join + 1 :] if line.lstrip(" :")[:2] == "+-" or len(line) - len(line.lstrip(" :+-")) > depth]
        first_branch = left[: next(i for i, line in enumerate(left) if line.lstrip(" ").startswith("+-") and len(line) - len(line.lstrip(" :+-")) == depth + 3)]
        assert first_branch and not any(word in line for line in first_branch for word in ("Window", "Sort", "Join", "Exchange"))
        assert "LeftOuter, BuildRight" in plan[join]


def test_size_is_measured(spark, spans, points):
    wide = spark.range(1000).select(F.array_repeat(F.lit(1.0), 1000).alias("v"), F.lit("x" * 50).alias("s"), F.create_map(F.lit("a"), F.lit(2)).alias("m"))
    assert lookup.fits(wide, ["v"], 8_100_000) and not lookup.fits(wide, ["v"], 7_900_000)
    assert lookup.fits(wide, ["s", "m"], 200_000) and not lookup.fits(wide, ["s", "m"], 60_000)
    assert lookup.fits(spark.createDataFrame([], "a array<string>"), ["a"], 0)


def test_large_tables_take_the_pass(spark, spans, points, monkeypatch):
    """Beyond the limit nothing is broadcast, and the result is the same."""
    right = spans.select("e", F.col("start").alias("at"), F.col("k").alias("hit"))
    small = sorted(map(str, asof.asof_join(points, right, ["e"], "t", "at", ["hit"], tiebreak="hit").collect()))
    monkeypatch.setattr(lookup, "INDEX_BYTES", 100)
    large = asof.asof_join(points, right, ["e"], "t", "at", ["hit"], tiebreak="hit")
    assert "Broadcast" not in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, large.collect())) == small


def test_empty_sides(spark, spans, points):
    none = spans.where("k < 0")
    assert intervals.binary_label(points, none, ["e"], "t").where("binary_label = 1").count() == 0
    assert intervals.lookup_interval(points, none, ["e"], "t", "start", "end", "k", ["word"]).where("word is not null").count() == 0
    assert asof.asof_join(points.where("t > 1000"), spans.select("e", F.col("start").alias("at"), "k"), ["e"], "t", "at", ["k"]).count() == 0
