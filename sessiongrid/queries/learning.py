"""Metrics, classifiers, fusion, cross-validation and configuration grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessiongrid.functions.vectors import argmax, mean_vector
from sessiongrid.operators import metrics, models, sampling, splits, windows
from sessiongrid.plans import evaluate
from sessiongrid.queries.base import load, query, sessions
from sessiongrid.queries.preparation import EMBEDDED, USERS_SQL, embedded
from sessiongrid.queries.windows import CALLS_SQL, calls

COUNTS_SQL = f"""{CALLS_SQL}, cf AS (SELECT y, yhat, count(*) AS n FROM pr GROUP BY y, yhat)"""
REPORT_SQL = """cl AS (SELECT y AS class FROM cf UNION SELECT yhat FROM cf),
rp AS (SELECT class, coalesce((SELECT sum(n) FROM cf WHERE y = class), 0) AS support, coalesce((SELECT sum(n) FROM cf WHERE yhat = class), 0) AS claimed,
  coalesce((SELECT sum(n) FROM cf WHERE y = class AND yhat = class), 0) AS tp FROM cl),
re AS (SELECT class, support, tp, CASE WHEN claimed > 0 THEN tp::DOUBLE / claimed ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall, 2 * tp::DOUBLE / (claimed + support) AS f1 FROM rp)"""
MACRO_SQL = """SELECT round(sum(tp)::DOUBLE / sum(support), 9) AS accuracy, round(avg(precision), 9) AS precision,
  round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM re"""


def _counts(spark, sf_dir):
    return metrics.confusion(calls(spark, sf_dir), "y", "yhat")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"""WITH {COUNTS_SQL} SELECT y, yhat, n FROM cf""")
def confusion(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"""WITH {COUNTS_SQL} SELECT y, coalesce(sum(n) FILTER (WHERE yhat = 0), 0)::BIGINT AS pred_0,
  coalesce(sum(n) FILTER (WHERE yhat = 1), 0)::BIGINT AS pred_1 FROM cf GROUP BY y""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_counts(spark, sf_dir), [0, 1])


@query(f"""WITH {COUNTS_SQL}, {REPORT_SQL} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  support::BIGINT AS support, tp::BIGINT AS tp FROM re""")
def per_class_metrics(spark, sf_dir):
    return _rounded(metrics.class_report(_counts(spark, sf_dir)), "precision", "recall", "f1")


@query(f"""WITH {COUNTS_SQL}, {REPORT_SQL} {MACRO_SQL}""")
def macro_metrics(spark, sf_dir):
    return _rounded(metrics.macro_metrics(_counts(spark, sf_dir)), "accuracy", "precision", "recall", "f1")


@query(f"""WITH {CALLS_SQL}, tl AS (SELECT y, CASE WHEN yhat = y OR yhat = lag(y) OVER w OR yhat = lead(y) OVER w THEN y ELSE yhat END AS yhat
  FROM pr WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
cf AS (SELECT y, yhat, count(*) AS n FROM tl GROUP BY y, yhat), {REPORT_SQL} {MACRO_SQL}""")
def macro_metrics_tolerant(spark, sf_dir):
    near = windows.tolerant_predictions(calls(spark, sf_dir), ["user_id"], ["us", "event_id"], "y", "yhat", 1)
    found = metrics.macro_metrics(metrics.confusion(near, "y", "tolerant"))
    return _rounded(found, "accuracy", "precision", "recall", "f1")


@query(f"""WITH {COUNTS_SQL}, {REPORT_SQL} SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  support::BIGINT AS support FROM re WHERE class = 1""")
def binary_metrics(spark, sf_dir):
    return _rounded(metrics.binary_metrics(_counts(spark, sf_dir)), "precision", "recall", "f1")


@query(f"""WITH {CALLS_SQL} SELECT round(avg((y = yhat)::INTEGER), 9) AS accuracy, round(avg((y = yhat)::INTEGER) - avg((y = 1)::INTEGER), 9) AS gain,
  count_if(y = 0)::BIGINT AS n_zero, round(avg((y = 0)::INTEGER), 9) AS share_zero FROM pr""")
def constant_baseline(spark, sf_dir):
    return _rounded(metrics.constant_baseline(_counts(spark, sf_dir)), "accuracy", "gain", "share_zero")


@query(f"""WITH {USERS_SQL}, {CALLS_SQL}
SELECT fo.fold, fo.split, count_if(y = 0)::BIGINT AS n_zero, count(*)::BIGINT AS n FROM pr JOIN fo ON fo.user_id = pr.user_id GROUP BY fo.fold, fo.split""")
def zero_count_by_split(spark, sf_dir):
    rows = calls(spark, sf_dir)
    split = splits.apply_folds(rows, splits.rotating_folds(rows, "user_id"), "user_id")
    return split.groupBy("fold", "split").agg(F.count_if(F.col("y") == 0).alias("n_zero"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CALLS_SQL}, c AS (SELECT k, count(*) AS t, count_if(y = 1) AS p FROM pr GROUP BY k),
r AS (SELECT *, sum(t) OVER (ORDER BY k) - t + (t + 1) / 2.0::DOUBLE AS mr FROM c)
SELECT round((sum(mr * p) - sum(p) * (sum(p) + 1) / 2.0::DOUBLE) / (sum(p) * (sum(t) - sum(p)))::DOUBLE, 9) AS auc FROM r""")
def auc(spark, sf_dir):
    return _rounded(metrics.area_under_roc(calls(spark, sf_dir), "y", "k"), "auc")


@query(f"""WITH {USERS_SQL}, {CALLS_SQL}, j AS (SELECT pr.event_id, y, fo.fold, fo.split FROM pr JOIN fo ON fo.user_id = pr.user_id),
c AS (SELECT fold, y, count(*) AS n FROM j WHERE split = 'train' GROUP BY fold, y),
b AS (SELECT fold, y AS yhat, row_number() OVER (PARTITION BY fold ORDER BY n DESC, y) AS rn FROM c)
SELECT j.fold, count(*)::BIGINT AS n, round(avg((j.y = b.yhat)::INTEGER), 9) AS accuracy FROM j JOIN b ON b.fold = j.fold AND b.rn = 1
WHERE j.split = 'test' GROUP BY j.fold""")
def majority_baseline(spark, sf_dir):
    rows = calls(spark, sf_dir).drop("yhat")
    split = splits.apply_folds(rows, splits.rotating_folds(rows, "user_id"), "user_id")
    guessed = models.majority_predictions(split, "y")
    return guessed.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("y") == F.col("yhat")).cast("int")), 9).alias("accuracy")
    )


@query("""
WITH p AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS a, [embedding[4]::DOUBLE, embedding[5]::DOUBLE, embedding[6]::DOUBLE] AS b FROM embeddings),
m AS (SELECT vec_id, [(a[1] + b[1]) / 2, (a[2] + b[2]) / 2, (a[3] + b[3]) / 2] AS m FROM p)
SELECT vec_id, (list_position(m, list_max(m)) - 1)::INTEGER AS yhat FROM m""")
def late_fusion_mean(spark, sf_dir):
    """Class of the mean of two score vectors."""
    scores = F.col("embedding").cast("array<double>")
    mean = mean_vector([F.slice(scores, 1, 3), F.slice(scores, 4, 3)])
    return load(spark, sf_dir, "embeddings").select("vec_id", argmax(mean).alias("yhat"))


AXES = {"stride": [1, 15, 30, 80], "length": [1, 15, 30, 80], "flavour": ["pca", "norm", "clean"],
        "audio": [True, False], "face": [True, False], "pose": [True, False]}
GRID_SQL = """g AS (SELECT stride, length, flavour, audio, face, pose, source FROM (SELECT unnest([1, 15, 30, 80]) AS stride),
  (SELECT unnest([1, 15, 30, 80]) AS length), (SELECT unnest(['pca', 'norm', 'clean']) AS flavour), (SELECT unnest([true, false]) AS audio),
  (SELECT unnest([true, false]) AS face), (SELECT unnest([true, false]) AS pose), (SELECT DISTINCT source FROM documents)
  WHERE stride <= length AND (audio OR face OR pose))"""


def _grid(spark, sf_dir):
    """Settings for every data source of a table."""
    sources = load(spark, sf_dir, "documents").select("source").distinct()
    keep = f"stride <= length AND ({models.any_flag(['audio', 'face', 'pose'])})"
    return models.config_grid(sources, AXES, keep)


@query(f"""WITH {GRID_SQL} SELECT * FROM g""")
def config_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@query(f"""WITH {GRID_SQL} SELECT *, md5(stride || '|' || length || '|' || flavour || '|' || audio || '|' || face || '|' || pose || '|' || source || '|7') AS config_id
FROM g ORDER BY config_id LIMIT 20""")
def random_search(spark, sf_dir):
    return models.shuffled_configs(_grid(spark, sf_dir), [*AXES, "source"], 7, 20)


GROUPS = {"pose": EMBEDDED[:24], "facial": EMBEDDED[24:48], "audio": EMBEDDED[48:]}


def _two_parts(spark, sf_dir):
    """Vectors with a three-class label, split by hash into train and test."""
    rows = embedded(spark, sf_dir).withColumn("label", F.col("label") % 3)
    folded = splits.row_folds(rows, ["vec_id"], 5)
    return folded.where("fold < 4"), folded.where("fold = 4")


def _scores(predictions):
    return metrics.macro_metrics(metrics.confusion(predictions, "label", "yhat"))


@query()
def random_forest_cv(spark, sf_dir):
    """Cross-validated forest on session rows: five rotating folds by user, tolerance of one row."""
    rows = calls(spark, sf_dir).drop("yhat").withColumn("hour", F.floor(F.col("t") / 3600) % 24)
    folds = splits.rotating_folds(rows, "user_id")
    found = evaluate.cross_validate(
        rows, folds, "user_id", ["us", "event_id"], ["value", "k", "hour"], "y",
        models.forest(5, 4, partitions=spark.sparkContext.defaultParallelism), tolerance=1,
        balance=lambda train: sampling.oversample_to_largest(train, "y", ["event_id"]).drop("copy"),
    )
    return evaluate.average_folds(found)


@query()
def feature_importance(spark, sf_dir):
    """Importances averaged over folds."""
    rows = splits.row_folds(embedded(spark, sf_dir).withColumn("label", F.col("label") % 3), ["vec_id"], 3)
    fit = models.forest(5, 4)
    parts = [
        models.importance_rows(spark, fit(rows.where(F.col("fold") != i), EMBEDDED, "label"), EMBEDDED, i) for i in range(3)
    ]
    return models.mean_importances(parts[0].union(parts[1]).union(parts[2]))


@query()
def grid_search(spark, sf_dir):
    rows = splits.row_folds(embedded(spark, sf_dir).withColumn("label", F.col("label") % 3), ["vec_id"], 3)
    return models.grid_search(rows, EMBEDDED, "label", "fold", [3, 6], [3])[1]


@query()
def group_ablation(spark, sf_dir):
    train, test = _two_parts(spark, sf_dir)
    return models.group_ablation(train, test, GROUPS, "label", models.forest(5, 4))


@query()
def early_fusion(spark, sf_dir):
    train, test = _two_parts(spark, sf_dir)
    return _scores(models.early_fusion(train, test, GROUPS, ["pose", "audio"], "label", models.forest(5, 4)))


@query()
def late_fusion(spark, sf_dir):
    train, test = _two_parts(spark, sf_dir)
    fused = models.late_fusion(train, test, GROUPS, ["pose", "facial", "audio"], "label", models.forest(5, 4))
    return _scores(fused)


@query()
def block_fusion(spark, sf_dir):
    train, test = _two_parts(spark, sf_dir)
    return _scores(models.block_fusion(train, test, GROUPS, ["pose", "audio"], "label", models.forest(5, 4)))


@query()
def mlp(spark, sf_dir):
    train, test = _two_parts(spark, sf_dir)
    model = models.layers(3, rounds=30)(train, EMBEDDED, "label")
    return _scores(models.predict(model, test, EMBEDDED))


@query()
def class_probabilities(spark, sf_dir):
    """Probability columns of the test rows."""
    train, test = _two_parts(spark, sf_dir)
    predicted = models.predict(models.forest(5, 4)(train, EMBEDDED, "label"), test, EMBEDDED)
    return models.probability_columns(predicted.select("vec_id", "fold", "label", "yhat", "p"), 3)


@query()
def window_classifier(spark, sf_dir):
    """A classifier on window summaries, by user."""
    rows = calls(spark, sf_dir).drop("yhat")
    made = windows.window_summaries(rows, ["user_id"], ["us", "event_id"], 10, ["value", "k"], "y")
    split = splits.apply_folds(made, splits.rotating_folds(rows, "user_id"), "user_id", 0)
    names = [c for c in made.columns if c.startswith(("value_", "k_"))]
    model = models.forest(5, 4)(split.where("split = 'train'"), names, "y")
    held = models.predict(model, split.where("split <> 'train'"), names)
    return metrics.macro_metrics(metrics.confusion(held, "y", "yhat", ["split"]), ["split"])
