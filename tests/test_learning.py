"""Cleaning, splits, resampling, scaling, components and models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessiongrid.operators import align, clean, metrics, models, sampling, scaling, smote, splits
from sessiongrid.operators.ordered import HashBlocks
from sessiongrid.plans import evaluate, frames


def test_bad_values(spark):
    rows = [(1, None), (2, float("nan")), (3, float("inf")), (4, float("-inf")), (5, -0.0), (6, 2.5)]
    df = spark.createDataFrame(rows, "i int, v double")
    audit = {r.column: (r.n_missing, r.n_infinite) for r in clean.audit_missing(df).collect()}
    assert audit == {"i": (0, 0), "v": (2, 2)}
    assert [r.v for r in clean.fill_nonfinite(df, ["v"]).orderBy("i").collect()] == [0, 0, 0, 0, 0, 2.5]
    means = {f: align.frame_means(df.withColumn("k", F.lit(1)).drop("i"), ["k"], f).first().v for f in ("zero", "ignore")}
    assert means == {"zero": pytest.approx(2.5 / 6), "ignore": pytest.approx(1.25)}
    texts = spark.createDataFrame([("",), (" 2.5 ",), ("x",), (None,)], "t string")
    assert [r.t for r in clean.coerce_numeric(texts, ["t"]).collect()] == [None, 2.5, None, None]


def test_entity_numbers(spark):
    df = spark.createDataFrame([("z", 1), ("a", 2), ("z", 3), ("m", 4)], "e string, i int")
    assert {(r.e, r.entity_no) for r in align.dense_entity_number(df, "e", ["i"]).collect()} == {("z", 0), ("a", 1), ("m", 2)}


@pytest.mark.parametrize("n", [5, 6, 7, 11, 24, 26])
def test_rotating_folds_partition_the_entities(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "e int")
    for blocks in (HashBlocks(), HashBlocks(1)):
        rows = splits.rotating_folds(df, "e", blocks=blocks).collect()
        assert len(rows) == 5 * n
        for fold in range(5):
            sizes = {s: sum(r.fold == fold and r.split == s for r in rows) for s in ("train", "val", "test")}
            assert sizes["train"] == math.floor(0.7 * n) and sizes["val"] == math.ceil(0.2 * n)
    with pytest.raises(ValueError):
        splits.rotating_folds(df.limit(4), "e")


def test_other_splits(spark):
    df = spark.createDataFrame([(i % 20, i) for i in range(400)], "e int, i int")
    fresh = splits.reshuffled_folds(df, "e").collect()
    assert {f: sum(r.fold == f and r.split == "train" for r in fresh) for f in range(5)} == dict.fromkeys(range(5), 14)
    runs = splits.block_folds(df, "e").collect()
    assert [sum(r.fold == f and r.split == "train" for r in runs) for f in range(5)] == [14, 6, 0, 0, 0]
    assert all(sum(r.fold == f and r.split == "val" for r in runs) == 4 for f in range(5))
    within = splits.within_entity_split(df, "e", ["i"], 0.6).where("e = 3").orderBy("i").collect()
    assert [r.split for r in within] == ["train"] * 12 + ["val"] * 2 + ["test"] * 6
    assert set(r.fold for r in splits.row_folds(df, ["i"]).collect()) == set(range(5))
    folds = splits.rotating_folds(df, "e")
    plain, salted = splits.apply_folds(df, folds, "e", 1), splits.apply_folds(df, folds, "e", 1, salts=7)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.select(plain.columns).collect()))
    with pytest.raises(ValueError):
        splits.require_filled(splits.apply_folds(df, splits.block_folds(df, "e"), "e", 4))


def test_resampling(spark):
    rows = [(e, i, c) for e in "ab" for i, c in enumerate([0] * 7 + [1] * 3)] + [("a", 99, 1)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "e string, i int, c int, id int")
    for blocks in (HashBlocks(), HashBlocks(2)):
        whole = sampling.undersample_to_smallest(df, "c", ["id"], blocks=blocks).collect()
        assert [sum(r.c == c for r in whole) for c in (0, 1)] == [7, 7]
        per = sampling.undersample_to_smallest(df, "c", ["id"], ["e"], blocks=blocks).collect()
        assert [sum(r.c == c and r.e == e for r in per) for e in "ab" for c in (0, 1)] == [4, 4, 3, 3]
        assert len({r.id for r in per}) == len(per)
    grown = sampling.oversample_to_largest(df, "c", ["id"]).collect()
    assert [sum(r.c == c for r in grown) for c in (0, 1)] == [14, 14]
    assert all(sum(r.id == x for r in grown) == 2 for x in {r.id for r in grown if r.c == 1})
    target = sampling.resample_to(df, "c", {0: 5}, ["id"]).collect()
    assert [sum(r.c == c for r in target) for c in (0, 1)] == [5, 7]


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(200, 2))
    x = np.column_stack([base[:, 0] * 5 + 3, base[:, 0] * 2 + r.normal(size=200) * 0.1, base[:, 1], np.full(200, 4.0)])
    rows = [(i, i % 8, int(v[0] > 3), *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "i int, e int, y int, `a.1` double, b double, c double, flat double").repartition(4).cache()


FEATURES = ["a.1", "b", "c", "flat"]


def test_standardised_moments(points):
    made = scaling.standardize(points, FEATURES).toPandas()
    for f in FEATURES[:3]:
        assert made[f].mean() == pytest.approx(0, abs=1e-9) and made[f].std(ddof=0) == pytest.approx(1)
    assert (made.flat == 0).all()
    folds = splits.rotating_folds(points, "e")
    each = scaling.standardize_per_fold(splits.apply_folds(points, folds, "e"), ["b", "flat"]).toPandas()
    train = each[(each.fold == 3) & (each.split == "train")]
    assert train.b.mean() == pytest.approx(0, abs=1e-9) and train.b.std(ddof=0) == pytest.approx(1)
    assert (each.flat == 0).all()


def test_components(points):
    fitted = scaling.Components.fit(points, FEATURES[:3], 0.9)
    assert fitted.count == 2
    loadings = fitted.loadings()
    assert loadings.T @ loadings == pytest.approx(np.eye(2), abs=1e-9)
    assert all(col[np.abs(col).argmax()] > 0 for col in loadings.T)
    x = points.orderBy("i").toPandas()[FEATURES[:3]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    got = fitted.transform(points).orderBy("i").toPandas()
    assert list(got.columns) == ["i", "e", "y", "flat", "pc1", "pc2"]
    assert got[["pc1", "pc2"]].to_numpy() == pytest.approx(z @ loadings, abs=1e-6)


def test_forest_and_cross_validation(points):
    folds = splits.rotating_folds(points, "e")
    fit = models.forest(5, 3)
    for flavour in ("clean", "norm", "pca"):
        rows = evaluate.cross_validate(points, folds, "e", ["i"], FEATURES, "y", fit, 2, flavour, tolerance=1)
        got = {(r.split, r.metric): r["mean"] for r in evaluate.average_folds(rows).collect()}
        assert len(got) == 16 and got["test", "accuracy"] > 0.7
        assert all(got[s, "accuracy_tolerant"] >= got[s, "accuracy"] for s in ("val", "test"))
    within = evaluate.cross_validate_within(points, [0, 5], "e", ["i"], FEATURES, "y", fit).collect()
    assert len(within) == 2 * 2 * 4


def test_fusions_and_tables(spark, points):
    train, test = points.where("i % 4 > 0"), points.where("i % 4 = 0")
    groups = {"one": ["a.1", "b"], "two": ["c", "flat"]}
    fit = models.forest(5, 3)
    for made in (
        models.early_fusion(train, test, groups, ["one", "two"], "y", fit),
        models.late_fusion(train, test, groups, ["one", "two"], "y", fit),
        models.block_fusion(train, test, {"one": ["a.1", "b"], "two": ["c"]}, ["one", "two"], "y", fit),
    ):
        rows = made.collect()
        assert len(rows) == 50 and all(sum(r.p) == pytest.approx(1) for r in rows)
    table = {r.features: r.accuracy for r in models.group_ablation(train, test, groups, "y", fit).collect()}
    assert set(table) == {"all", "no_one", "no_two"} and table["all"] > table["no_one"]
    found, grid = models.grid_search(splits.row_folds(points, ["i"], 3), FEATURES, "y", "fold", [3], [1, 3])
    assert grid.count() == 2 and found.bestModel.getNumTrees == 3
    weights = models.importance_rows(spark, fit(train, FEATURES, "y"), FEATURES, 0)
    assert models.mean_importances(weights).agg(F.sum("importance")).first()[0] == pytest.approx(1)
    scored = models.probability_columns(models.predict(fit(train, FEATURES, "y"), test, FEATURES), 2)
    assert scored.columns[-2:] == ["class_0", "class_1"]


def test_grid(spark):
    grid = models.config_grid(spark.range(1).select(), {"stride": [1, 15], "length": [1, 15], **models.modality_flags(["a", "b"])},
                              f"stride <= length AND ({models.any_flag(['a', 'b'])})")
    assert grid.count() == 3 * 3
    assert models.shuffled_configs(grid, ["stride", "length", "a", "b"], 1, 4).count() == 4


def test_raw_tables_to_labelled_frames(spark):
    """Keypoints, face, audio and gaze of two sessions to one labelled table."""
    r = random.Random(1)
    pose = spark.createDataFrame(
        [(p, f, r.random(), 0.9) for p in ("p1", "p2") for f in range(40)], "participant string, frame int, nose_x double, nose_c double"
    )
    face = pose.select("participant", "frame", F.lit(1.0).alias("AU01_r"))
    gaze = pose.where("frame % 2 = 0").select("participant", "frame", F.lit(0.5).alias("gaze_0_x"))
    audio = spark.createDataFrame(
        [(p, f"0 days 00:00:00.{i * 20:03d}", f"0 days 00:00:00.{i * 20 + 20:03d}", "2.0" if i else "") for p in ("p1", "p2") for i in range(45)],
        "participant string, start string, end string, Loudness_sma3 string",
    )
    turns = spark.createDataFrame([("p1", "participant", 0.0, 0.5), ("p2", "robot", 0.0, 9.0)], "participant string, speaker string, start double, end double")
    errors = spark.createDataFrame([("p1", [5, 10, 20]), ("p2", [])], "participant string, errors array<int>")
    sound = frames.audio_frames(audio, turns)
    made = frames.merge_modalities(frames.pose_frames(pose), face, sound, gaze, errors)
    assert made.columns[:5] == ["frame", "participant", "binary_label", "multiclass_label", "nose_x_delta"]
    rows = {(x.participant, x.frame): x for x in made.collect()}
    assert rows["p1", 5].multiclass_label == 1 and rows["p1", 10].multiclass_label == 1 and rows["p1", 11].multiclass_label == 2
    assert rows["p1", 4].binary_label == 0 and rows["p2", 8].binary_label == 0
    assert rows["p1", 8].Loudness_sma3 == 2.0 and rows["p2", 8].Loudness_sma3 == 0.0
    assert rows["p1", 3].gaze_0_x is None and rows["p1", 4].gaze_0_x == 0.5
    assert len(rows) == 2 * 27
    named = frames.modality_tables(made, ["pose", "facial_gaze"], ["clean", "norm"])
    assert named["facial_gaze", "norm"].columns[4:] == ["AU01_r", "gaze_0_x"]


def test_metric_report_of_baseline(points):
    folds = splits.apply_folds(points, splits.rotating_folds(points, "e"), "e")
    guessed = models.majority_predictions(folds, "y")
    assert guessed.select("yhat").distinct().count() <= 2
    counts = metrics.confusion(guessed, "y", "yhat", ["fold"])
    gains = metrics.constant_baseline(counts, ["fold"]).collect()
    assert len(gains) == 5 and all(0 <= g.accuracy <= 1 for g in gains)


@pytest.mark.parametrize("pivots,piece", [(1, 1000), (9, 1000), (30, 7)])
def test_nearest_neighbours_are_exact(spark, pivots, piece):
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(60, 3)), r.normal(size=(40, 3)) * 0.05 + 4, np.zeros((8, 3))])
    rows = spark.createDataFrame([(str(i), [float(a) for a in v]) for i, v in enumerate(x)], "_id string, _v array<double>")
    got = {row["_id"]: row.near for row in smote.nearest_neighbours(rows, 5, pivots, piece).collect()}
    assert len(got) == len(x)
    for i, v in enumerate(x):
        away = np.sort(np.delete(np.linalg.norm(x - v, axis=1), i))[:5]
        assert np.linalg.norm(np.array(got[str(i)]) - v, axis=1) == pytest.approx(away, abs=1e-6)


def test_smote_fills_the_minority(spark):
    r = np.random.default_rng(1)
    rows = [(i, 0, *map(float, r.normal(size=2))) for i in range(40)] + [(100 + i, 1, *map(float, r.normal(size=2) + 9)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double")
    made = smote.smote(df, ["a", "b"], "y", ["id"], k=3).toPandas()
    assert (made.y == 0).sum() == (made.y == 1).sum() == 40 and made.synthetic.sum() == 28
    real, new = made[(made.y == 1) & ~made.synthetic], made[made.synthetic]
    assert new.a.between(real.a.min(), real.a.max()).all() and new.b.between(real.b.min(), real.b.max()).all()
    with pytest.raises(ValueError):
        smote.smote(df.where("id < 103"), ["a", "b"], "y", ["id"], k=3)
