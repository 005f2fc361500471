"""Merged sketches against exact ranks, and one-pass fits against separate ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessiongrid.operators import scaling, sketches
from sessiongrid.plans import modalities


@pytest.fixture(scope="module")
def values(spark):
    rows = spark.range(40_000, numPartitions=4).select(
        (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("day"), F.exp(F.randn(3)).alias("v"), (F.col("id") % 5).cast("double").alias("few"),
        F.when(F.col("id") % 3 == 2, None).otherwise(F.when(F.col("id") % 10 == 0, float("nan")).when(F.col("id") % 11 == 0, float("inf")).otherwise(F.randn(4))).alias("holes"),
    )
    return rows.cache()


NAMES = ["v", "few", "holes"]


def test_rank_errors_stay_in_the_bound(values):
    daily = sketches.value_sketches(values, ["g", "day"], NAMES).cache()
    merged, whole = sketches.merged_sketches(daily, ["g"]), sketches.value_sketches(values, ["g"], NAMES)
    for found in (merged, whole):
        errors = sketches.rank_errors(values, found, ["g"], NAMES, (0.01, 0.3, 0.5, 0.99)).collect()
        assert len(errors) == 4 * (3 + 3 + 2) and all(0 <= r.error <= sketches.ERROR for r in errors)
    both = {(r.g, r.feature): (r.n, r.low, r.high) for r in merged.collect()}
    assert both == {(r.g, r.feature): (r.n, r.low, r.high) for r in whole.collect()}
    empty = [r for r in sketches.sketch_quantiles(merged).collect() if r.n == 0]
    assert len(empty) == 1 and empty[0].quantiles is None and empty[0].sketch is None


def test_sketches_do_not_grow_with_rows(spark, values):
    size = F.length("sketch")
    small = sketches.value_sketches(values.limit(5000), [], ["v"]).select(size).first()[0]
    large = sketches.value_sketches(values.crossJoin(spark.range(10)).withColumn("v", F.col("v") * F.rand(1)), [], ["v"]).select(size).first()[0]
    assert large < 3 * small and sketches.sketch_size(0.02) < sketches.sketch_size(0.01)
    with pytest.raises(ValueError):
        sketches.sketch_size(1e-9)


def test_box_stats_of_few_values(values):
    found = sketches.sketched_box_stats(values, sketches.value_sketches(values, ["g"], ["few"]), ["g"], "few").collect()
    assert [(r.q1, r.median, r.q3, r.whisker_low, r.whisker_high) for r in found] == [(1.0, 2.0, 3.0, 0.0, 4.0)] * 3


@pytest.fixture(scope="module")
def frames(spark):
    base = spark.range(3000, numPartitions=3).select(F.col("id").alias("frame"), F.randn(1).alias("a"), F.randn(2).alias("b"), F.randn(3).alias("n"))
    return base.select(
        "frame", (F.col("a") * 5 + 1e6).alias("p1"), (F.col("a") + F.col("b") / 3).alias("p2"), F.when(F.col("frame") % 9 == 0, None).otherwise(F.col("b")).alias("p3"),
        F.lit(4.0).alias("flat"), F.col("n").alias("s1"), (F.col("n") - F.col("a")).alias("s2"),
    ).cache()


GROUPS = {"pose": ["p1", "p2", "p3", "flat"], "sound": ["s1", "s2"]}


def test_tables_equal_separate_fits(frames):
    """Means, spreads and components of every subset from the one matrix are those of fits of its own."""
    tables = modalities.modality_tables(frames, ["pose", "sound", "pose_sound"], groups=GROUPS, keys=["frame"])
    assert len(tables) == 9
    for combination in ("pose", "sound", "pose_sound"):
        clean = tables[combination, "clean"]
        names = [c for c in clean.columns if c != "frame"]
        for flavour, other in (("norm", scaling.standardize(clean, names)), ("pca", scaling.reduce_components(clean, names))):
            mine, own = (df.orderBy("frame").toPandas() for df in (tables[combination, flavour], other))
            assert list(mine.columns) == list(own.columns)
            for c in own.columns:
                same = np.allclose(mine[c], own[c], atol=1e-5)
                assert same or np.allclose(mine[c], -own[c], atol=1e-5) and c.startswith("pc")


def test_one_scan_fits_all(spark, frames):
    """However many tables are asked for, the frames are fitted by one job over them and one over their head."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fit", "fit")
    modalities.modality_tables(frames, ["pose", "sound", "pose_sound"], groups=GROUPS, keys=["frame"])
    many = len(tracker.getJobIdsForGroup("fit"))
    spark.sparkContext.setJobGroup("fit one", "fit one")
    modalities.modality_tables(frames, ["pose"], ["norm"], groups=GROUPS, keys=["frame"])
    assert many == len(tracker.getJobIdsForGroup("fit one")) > 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_odd_tables(spark, frames):
    gram = modalities.Gram.fit(frames.select("flat"), ["flat"])
    assert gram.standardizer(["flat"]).deviations == {"flat": 0.0} and gram.components(["flat"]).transform(frames.select("frame", "flat")).first().pc1 == 0.0
    with pytest.raises(ValueError):
        modalities.Gram.fit(frames.where("frame < 0"), ["p1"])
    with pytest.raises(ValueError):
        modalities.modality_tables(frames, ["pose"], ["other"], groups=GROUPS, keys=["frame"])
