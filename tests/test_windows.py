"""Windows and ranks against brute force and hand-made edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessiongrid.operators import aggregate, rank, windows
from sessiongrid.operators.ordered import Blocks

MANY = Blocks((4.0, 9.0, 15.0))
OPTIONS = [{"blocks": Blocks()}, {"blocks": MANY, "rows_per_block": 8}]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    frames = [f for f in range(26) if f not in (5, 13)]
    data = [("a", f, round(r.uniform(-1, 1), 3), r.randint(0, 2), r.randint(0, 2)) for f in frames]
    data += [("b", f, float(f), 1, 0) for f in range(3)] + [("c", 7, 2.5, 0, 0)]
    r.shuffle(data)
    return spark.createDataFrame(data, "e string, frame int, x double, y int, yhat int").cache()


def by_entity(rows):
    found = {}
    for r in sorted(rows.collect(), key=lambda r: (r.e, r.frame)):
        found.setdefault(r.e, []).append(r)
    return found


@pytest.mark.parametrize("options", OPTIONS)
def test_deltas(rows, options):
    made = windows.frame_deltas(rows, ["e"], ["frame"], ["x"], **options)
    assert made.columns == ["e", "frame", "x", "x_delta", "y", "yhat"]
    got = {(r.e, r.frame): r.x_delta for r in made.collect()}
    for e, rs in by_entity(rows).items():
        for i, r in enumerate(rs):
            want = 0.0 if i == 0 else round(r.x - rs[i - 1].x, 4)
            assert got[e, r.frame] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("length", [1, 3, 4])
def test_sliding(rows, options, length):
    made = windows.sliding_sequences(rows, ["e"], ["frame"], length, ["x", "frame"], "y", **options).collect()
    want = {}
    for e, rs in by_entity(rows).items():
        for i in range(len(rs) - length + 1):
            part = rs[i : i + length]
            want[e, part[-1].frame] = ([[p.x, float(p.frame)] for p in part], part[-1].y)
    assert {(r.e, r.frame): (r.x, r.y) for r in made} == want
    assert len(made) == sum(max(len(rs) - length + 1, 0) for rs in by_entity(rows).values())


def test_contiguous_windows_skip_gaps(rows):
    made = windows.sliding_sequences(rows, ["e"], ["frame"], 4, ["x"], "y", "frame", True).collect()
    assert {r.frame for r in made if r.e == "a"} == {3, 4, 9, 10, 11, 12, *range(17, 26)}


@pytest.mark.parametrize("length,stride,context", [(4, 4, 0), (4, 2, 3), (3, 5, 0), (26, 1, 0)])
def test_strided(rows, length, stride, context):
    width = length + context
    for blocks in (Blocks(), MANY):
        made = windows.strided_windows(rows, ["e"], ["frame"], length, stride, ["x"], "y", context, blocks).collect()
        want = {}
        for e, rs in by_entity(rows).items():
            for i in range(0, len(rs), stride):
                if i + width <= len(rs):
                    want[e, i // stride] = ([[p.x] for p in rs[i : i + width]], rs[i + width - 1].y)
        assert {(r.e, r.window_id): (r.x, r.y) for r in made} == want


@pytest.mark.parametrize("options", OPTIONS)
def test_summaries(rows, options):
    made = windows.window_summaries(rows, ["e"], ["frame"], 5, ["x"], "y", **options).collect()
    for r in made:
        rs = by_entity(rows)[r.e]
        end = [q.frame for q in rs].index(r.frame)
        x = np.array([q.x for q in rs[end - 4 : end + 1]])
        want = [x.mean(), x.std(), x.min(), x.max(), x[-1], np.polyfit(np.arange(5), x, 1)[0]]
        assert [r.x_mean, r.x_sd, r.x_min, r.x_max, r.x_last, r.x_slope] == pytest.approx(want)
    assert len(made) == 20


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("tolerance", [0, 1, 3])
def test_tolerance_stays_in_the_session(rows, options, tolerance):
    made = windows.tolerant_predictions(rows, ["e"], ["frame"], "y", "yhat", tolerance, **options).collect()
    for r in made:
        rs = by_entity(rows)[r.e]
        i = [q.frame for q in rs].index(r.frame)
        near = {q.y for q in rs[max(0, i - tolerance) : i + tolerance + 1]}
        assert r.tolerant == (r.y if r.yhat in near else r.yhat)


def test_unrolled_predictions(spark):
    frames = spark.createDataFrame([("a", i) for i in range(11)], "e string, idx int")
    predictions = spark.createDataFrame([("a", 0, 5), ("a", 1, 6), ("a", 2, 7)], "e string, window_id int, p int")
    got = windows.unroll_windows(frames, predictions, ["e"], "idx", "p", 5, 2).orderBy("idx").collect()
    assert [r.p for r in got] == [5, 5, 5, 6, 6, 7, 7, 0, 0, 0, 0]


def test_midranks_and_quantiles_in_blocks(spark):
    r = random.Random(8)
    data = [(g, float(r.choice([r.randint(-3, 18), r.uniform(0, 18)]))) for g in "aab" for _ in range(60)] + [("b", -0.0), ("b", 0.0)]
    df = spark.createDataFrame(data, "g string, v double")
    for blocks in (Blocks(), MANY):
        got = {(x.g, x.v): x.midrank for x in rank.midranks(df, ["g"], "v", blocks).collect()}
        quantiles = {x.g: x.quantiles for x in rank.exact_quantiles(df, ["g"], "v", [0, 0.1, 0.5, 0.77, 1], blocks).collect()}
        boxes = {x.g: x for x in aggregate.box_stats(df, ["g"], "v", blocks=blocks).collect()}
        for g in "ab":
            values = np.array([v for k, v in data if k == g])
            for v in set(values):
                assert got[g, v] == (values < v).sum() + ((values == v).sum() + 1) / 2
            assert quantiles[g] == pytest.approx(list(np.quantile(values, [0, 0.1, 0.5, 0.77, 1])))
            q1, q3 = np.quantile(values, [0.25, 0.75])
            inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
            assert (boxes[g].whisker_low, boxes[g].whisker_high) == (inside.min(), inside.max())


def test_cut_keeps_everything_without_a_drop(spark):
    flat = spark.createDataFrame([("a", 3.0), ("b", 2.9), ("c", 2.8)], "feature string, importance double")
    ranked = rank.ranked_drops(flat)
    assert rank.cut_at_drop(ranked).count() == 3
    assert rank.cut_at_drop(rank.ranked_drops(flat.union(spark.createDataFrame([("d", 0.1)], flat.schema.names[:1] + ["importance"])))).count() == 2


def test_first_share_and_first_row(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(7)] + [("b", 0, 1)], "g string, i int, z int")
    assert rank.first_share(df, ["g"], ["i"], 0.5).count() == 3
    first = {r.g: r.i for r in rank.first_per_group(df, ["g"], ["z", "i"]).collect()}
    assert first == {"a": 0, "b": 0}


def test_turn_gaps_only_between_speakers(spark):
    turns = spark.createDataFrame(
        [("p", "x", 0.0, 1.0), ("p", "y", 0.5, 2.0), ("p", "y", 3.0, 4.0), ("p", "x", 4.25, 5.0)],
        "p string, speaker string, start double, end double",
    )
    got = windows.turn_gaps(turns, ["p"]).orderBy("start").collect()
    assert [(r.start, r.gap) for r in got] == [(0.0, 0.0), (3.0, 0.25)]


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(50)] + [("b", 2.0), ("b", 3.5)], "g string, v double")
    for bin_width in (None, 0.01):
        grid = aggregate.kde_grid(df, "g", "v", -20.0, 30.0, 501, bin_width).groupBy("g").agg(F.sum("density").alias("s"))
        for r in grid.collect():
            assert r.s * 0.1 == pytest.approx(1.0, abs=1e-6)
