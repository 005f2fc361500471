"""Training in steps, an encoder that sees each text once, and the store of vectors by key."""

import pytest
from pyspark.sql import functions as F

from sessiongrid.operators import metrics, models
from sessiongrid.plans import history
from sessiongrid.session import new_path
from sessiongrid.sources import captions, store


@pytest.fixture(scope="module")
def training(spark):
    rows = spark.range(400).select(
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 500 - 1).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 500 - 1).alias("b"), "id"
    )
    rows = rows.withColumn("y", (F.col("a") * F.col("b") > 0).cast("int"))
    return rows, history.train_in_steps(rows.where("id % 4 > 0"), rows.where("id % 4 = 0"), ["a", "b"], "y", 2, hidden=(8,), steps=4, rounds=10, config_id="c")


def test_loss_goes_on_over_steps(training):
    _, made = training
    rows = made.history.where("metric = 'loss'").orderBy("epoch").collect()
    losses = [r.value for r in rows]
    assert [r.epoch for r in rows] == list(range(len(rows))) and len(rows) == max(made.models) + 1 > 20
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:])) and losses[-1] < losses[0] * 0.8
    assert {(r.config_id, r.split) for r in rows} == {("c", "train")}


def test_best_step_is_the_model_of_its_metrics(training):
    rows, made = training
    epoch, model = made.best()
    held = {r.epoch: r.value for r in made.history.where("split = 'val' AND metric = 'accuracy'").collect()}
    assert set(held) == set(made.models) and held[epoch] == max(held.values())
    assert epoch == max(e for e, v in held.items() if v == held[epoch])
    scored = models.predict(model, rows.where("id % 4 = 0"), ["a", "b"])
    assert metrics.macro_metrics(metrics.confusion(scored, "y", "yhat")).first().accuracy == held[epoch]


def test_equal_texts_are_encoded_once(spark):
    seen, loads = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def encoder(texts):
            seen.add(len(texts))
            return [[float(len(t))] for t in texts]

        return encoder

    rows = [(i, t) for i, t in enumerate(["same"] * 300 + ["", None, "other", "one more"])]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("vector", F.lit("mine")).repartition(5)
    made = captions.encode_distinct(df, "t", load, "vector", batch=2, tasks=3)
    assert made.columns == ["i", "t", "vector"]
    assert {r.i: r.vector for r in made.collect()} == {i: [float(len(t or ""))] for i, t in rows}
    assert made.count() == len(rows) and seen.value == 4 and loads.value <= 3
    assert captions.encode_distinct(df.limit(0), "t", load, "v").count() == 0


def files_read(df):
    """The number of files that the scan of a plan without exchanges opened."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numFiles").get().value()


def test_lookup_opens_the_folders_of_its_keys(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("s"), F.col("id") % 7).alias("s"), F.array(F.col("id").cast("float"), F.lit(0.5)).alias("v"))
    path = new_path(spark)
    store.write_vectors_by_key(rows, path, ["k", "s"], "v", buckets=32)
    stored = spark.read.parquet(path)
    assert stored.count() == 5000 and files_read(stored) >= 32
    wanted = spark.createDataFrame([(17, "s3", "mine"), (17, "s3", "again"), (18, "s0", "no such key"), (None, "s1", "null")], "k int, s string, v string")
    found = store.lookup_vectors(wanted, path, ["k", "s"])
    assert sorted(tuple(r) for r in found.select("k", "s", "v").collect() if r.v) == [(17, "s3", [17.0, 0.5])] * 2 and found.count() == 4
    place = f"{store.BUCKETS}32"
    folders = {r[0] for r in stored.join(wanted.select(F.col("k").cast("long").alias("k"), "s"), ["k", "s"]).select(place).distinct().collect()}
    assert len(folders) == 1 and files_read(stored.where(F.col(place).isin(list(folders)))) < 4
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and place in plan.split("PartitionFilters: [")[1].split("]")[0]
