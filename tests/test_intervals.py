"""Interval operators against brute force, in one block and in many."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sessiongrid.operators import annotations, asof, intervals
from sessiongrid.operators.ordered import Blocks, plan_blocks

MANY = Blocks((5.0, 10.0, 20.5, 33.0))
BLOCKS = [None, MANY]


@pytest.fixture(scope="module")
def spans(spark):
    r = random.Random(4)
    data = [(r.choice("ab"), s, s + r.randint(0, 8), k) for k in range(60) for s in [r.randint(0, 50)]]
    return spark.createDataFrame(data, "e string, start int, end int, k int").cache()


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(e, p / 2.0) for e in "abc" for p in range(-2, 124)], "e string, t double").cache()


def holding(spans, e, t):
    return [r.k for r in spans if r.e == e and r.start <= t <= r.end]


@pytest.mark.parametrize("blocks", BLOCKS)
@pytest.mark.parametrize("pick", ["first", "last"])
def test_lookup_takes_first_or_last(spans, points, pick, blocks):
    made = intervals.lookup_interval(
        points, spans.withColumn("hit", F.col("k")), ["e"], "t", "start", "end", "k", ["hit"], pick, blocks
    ).collect()
    every = spans.collect()
    assert len(made) == points.count()
    for r in made:
        found = holding(every, r.e, r.t)
        assert r.hit == ((min(found) if pick == "first" else max(found)) if found else None)


@pytest.mark.parametrize("blocks", BLOCKS)
def test_containment_labels_and_mask(spans, points, blocks):
    every = spans.collect()
    wide = points.withColumn("t2", F.col("t") + 1.5)
    for r in intervals.mark_contained(wide, spans, ["e"], "t", "t2", blocks=blocks).collect():
        assert r.contained == any(s.e == r.e and s.start <= r.t and r.t2 <= s.end for s in every)
    for r in intervals.binary_label(points, spans, ["e"], "t", blocks=blocks).collect():
        assert r.binary_label == int(bool(holding(every, r.e, r.t)))
    left = {(r.e, r.t) for r in intervals.mask_intervals(points, spans, ["e"], "t", blocks=blocks).collect()}
    for r in points.collect():
        assert ((r.e, r.t) in left) == (not any(s.e == r.e and s.start <= r.t < s.end for s in every))


@pytest.mark.parametrize("blocks", BLOCKS)
def test_boundaries_share_bounds_and_first_wins(spark, points, blocks):
    bounds = spark.createDataFrame([("a", [3, 10, 17, 40]), ("b", [5, 9]), ("c", [])], "e string, errors array<int>")
    chain = intervals.boundaries_to_intervals(bounds, ["e"])
    lists = {"a": [3, 10, 17, 40], "b": [5, 9], "c": []}
    for r in intervals.multiclass_label(points, chain, ["e"], "t", blocks=blocks).collect():
        b = lists[r.e]
        want = next((k for k in range(1, len(b)) if b[k - 1] <= r.t <= b[k]), 0)
        assert r.multiclass_label == want, r


def test_intervals_with_a_gap(spark, points):
    gapped = spark.createDataFrame([("a", 1, 2.0, 4.0), ("a", 2, 6.0, 8.0), ("a", 3, 8.0, 9.0)], "e string, k int, start double, end double")
    got = {r.t: r.multiclass_label for r in intervals.multiclass_label(points.where("e = 'a'"), gapped, ["e"], "t").collect()}
    assert [got[t] for t in (1.5, 2.0, 4.0, 4.5, 6.0, 8.0, 8.5, 9.0, 9.5)] == [0, 1, 1, 0, 2, 2, 3, 3, 0]


@pytest.mark.parametrize("blocks", BLOCKS)
@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spans, points, blocks, direction, strict):
    right = spans.select("e", F.col("start").alias("at"), F.col("k").alias("hit"))
    every = right.collect()
    made = asof.asof_join(points, right, ["e"], "t", "at", ["hit"], direction, strict, "hit", blocks).collect()
    assert len(made) == points.count()
    for r in made:
        if direction == "backward":
            found = [(x.at, x.hit) for x in every if x.e == r.e and (x.at < r.t or (x.at == r.t and not strict))]
            want = max(found)[1] if found else None
        else:
            found = [(x.at, x.hit) for x in every if x.e == r.e and (x.at > r.t or (x.at == r.t and not strict))]
            want = min(found)[1] if found else None
        assert r.hit == want


def test_asof_rejects_shared_names(points):
    with pytest.raises(ValueError):
        asof.asof_join(points, points, ["e"], "t", "t", ["t"])


def test_next_window_past_the_end(spark):
    points = spark.createDataFrame([("a", 0.4), ("a", 1.0), ("a", 9.0)], "e string, t double")
    windows = spark.createDataFrame([("a", k, 1.0 + k / 2) for k in range(4)], "e string, window_id int, end_time double")
    strict = {r.t: r.window_id for r in intervals.next_window(points, windows, ["e"], "t").collect()}
    legacy = {r.t: r.window_id for r in intervals.next_window(points, windows, ["e"], "t", legacy=True).collect()}
    assert strict == {0.4: 0, 1.0: 1, 9.0: None}
    assert legacy == {0.4: 0, 1.0: 1, 9.0: 0}
    closed = points.select("t", intervals.regular_window(F.col("t"), 1.0, 0.5, F.lit(4)).alias("k")).collect()
    assert {r.t: r.k for r in closed} == strict


def test_response_summary_agrees_with_all_pairs(spark):
    r = random.Random(2)
    notes = spark.createDataFrame([(r.choice("ab"), float(r.randint(0, 40))) for _ in range(50)], "e string, start double")
    errors = spark.createDataFrame([(r.choice("abc"), i, float(i * 3)) for i in range(12)], "e string, error int, end double")
    want = sorted(
        (x.e, x.error, n.start - x.end) for x in errors.collect() for n in notes.collect() if n.e == x.e and n.start > x.end
    )
    for blocks in BLOCKS:
        for x in annotations.response_summary(notes, errors, "e", blocks=blocks).collect():
            mine = [t for e, k, t in want if (e, k) == (x.e, x.error)]
            assert x.n_later == len(mine)
            assert (x.mean_response is None) == (not mine)
            if mine:
                assert x.mean_response == pytest.approx(sum(mine) / len(mine)) and x.first_response == min(mine)


def test_window_labels(spark):
    labels = spark.createDataFrame([("a", 0.2, "x"), ("a", 0.7, "y"), ("a", 0.9, "y"), ("a", 1.4, "x")], "e string, t double, label string")
    windows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.5, 1.5), ("a", 1.0, 1.4), ("a", 3.0, 4.0)], "e string, start_time double, end_time double")
    first = {r.start_time: r.label for r in intervals.window_first_label(windows, labels, ["e"], "t", "label").collect()}
    assert first == {0.0: "x", 0.5: "y", 1.0: None, 3.0: None}
    mode = {r.window_id: r.label for r in intervals.window_mode_label(labels, ["e"], "t", "label", 1.0, 0.5).collect()}
    assert mode == {0: "y", 1: "y", 2: "x"}


@pytest.mark.parametrize("blocks", BLOCKS)
def test_times_above_2_to_53_keep_their_digits(spark, blocks):
    base = 1_700_000_000_000_000_000
    left = spark.createDataFrame([("a", base + 1), ("a", base + 3)], "e string, t long")
    right = spark.createDataFrame([("a", base), ("a", base + 2)], "e string, at long").withColumn("hit", F.col("at") - base)
    got = {r.t - base: r.hit for r in asof.asof_join(left, right, ["e"], "t", "at", ["hit"], blocks=blocks).collect()}
    assert got == {1: 0, 3: 2}
    spans = right.select("e", F.col("at").alias("start"), (F.col("at") + 1).alias("end"), F.col("hit").alias("k"))
    marked = {r.t - base: r.binary_label for r in intervals.binary_label(left.union(spark.createDataFrame([("a", base + 5)], "e string, t long")), spans, ["e"], "t", blocks=blocks).collect()}
    assert marked == {1: 1, 3: 1, 5: 0}
    found = {r.t - base: r.k for r in intervals.lookup_interval(left, spans, ["e"], "t", "start", "end", "k", ["k"], blocks=blocks).collect()}
    assert found == {1: 0, 3: 2}


def test_asof_on_timestamps_in_blocks(spark):
    left = spark.sql("SELECT 'a' AS e, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS t FROM range(60)")
    right = spark.sql("SELECT 'a' AS e, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 7) AS at, id AS hit FROM range(9)")
    both = left.select("t").union(right.select("at"))
    cut = plan_blocks(both, "t", 10)
    assert len(cut.cuts) > 3
    got = sorted(asof.asof_join(left, right, ["e"], "t", "at", ["hit"], blocks=cut).collect())
    assert [r.hit for r in got] == [k // 7 for k in range(60)]


def test_response_summary_of_epoch_micros(spark):
    base = 1_704_067_200_000_000
    notes = spark.range(200_000).select(F.lit("a").alias("e"), (base + F.col("id") + 1).alias("start"))
    errors = spark.createDataFrame([("a", 0, base)], "e string, error int, end long")
    for times in (notes, notes.withColumn("start", F.col("start").cast("double"))):
        row = annotations.response_summary(times, errors, "e").first()
        assert (row.n_later, row.mean_response, row.first_response) == (200_000, 100_000.5, 1.0)


def test_legacy_window_is_the_first_in_time(spark):
    points = spark.createDataFrame([("a", 9.0)], "e string, t double")
    windows = spark.createDataFrame([("a", 7, 1.0), ("a", 3, 2.0)], "e string, window_id int, end_time double")
    assert intervals.next_window(points, windows, ["e"], "t", legacy=True).first().window_id == 7


def test_consecutive_intervals_in_blocks(spark):
    events = spark.createDataFrame([("a", float(t)) for t in range(0, 40, 3)] + [("b", 1.0), ("c", 5.0), ("c", 20.0)], "e string, t double")
    for blocks in BLOCKS:
        rows = sorted(map(tuple, intervals.consecutive_intervals(events, ["e"], "t", blocks).collect()))
        assert rows == [("a", k + 1, 3.0 * k, 3.0 * k + 3) for k in range(13)] + [("c", 1, 5.0, 20.0)]


def test_lookups_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    """More intervals are more tasks, not longer ones, and the winners stay those of brute force."""
    spans = [(e, float(s), float(s + 1 + (7 * s + k) % 40), 10 * s + k) for e in ("a", None) for s in range(60) for k in range(2)]
    df = spark.createDataFrame(spans, "e string, start double, end double, k int")
    monkeypatch.setattr(intervals, "LOOKUPS_PER_TASK", 100)
    for pick, best in (("first", min), ("last", max)):
        steps = intervals.winning_steps(df, ["e"], "start", "end", "k", ["k"], pick)
        tasks = [int(n) for n in re.findall(r", ([0-9]+)\), REPARTITION_BY_NUM", steps._jdf.queryExecution().executedPlan().toString())]
        assert tasks and min(tasks) >= 240 * 2 * 7 / 100
        for r in steps.where("e = 'a'").collect():
            at = r._time + r._side / 4
            assert r.k == best((k for e, s, t, k in spans if e == "a" and s <= at <= t), default=None)
