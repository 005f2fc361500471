"""Classification metrics from confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.operators.ordered import Blocks, column
from sessiongrid.operators.rank import value_counts_ranked


def confusion(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts ``n`` per true and predicted class (and key)."""
    return df.groupBy(*map(column, keys), column(truth).alias("y"), column(predicted).alias("yhat")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(counts: DataFrame, classes: Sequence) -> DataFrame:
    """One row per true class, one column per predicted class."""
    cells = [F.sum(F.when(F.col("yhat") == F.lit(c), F.col("n")).otherwise(0)).alias(f"pred_{c}") for c in classes]
    return counts.groupBy("y").agg(*cells)


def class_report(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class in truth or prediction, 0 on empty."""
    hit = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"), hit.cast("long").alias("tp")),
        F.struct(F.col("yhat").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("tp")),
    )
    totals = (
        counts.select(*map(column, keys), F.inline(sides))
        .groupBy(*map(column, keys), "class")
        .agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("tp").alias("tp"))
    )
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    return totals.select(
        *map(column, keys), "class",
        ratio(F.col("tp"), F.col("claimed")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(F.col("tp") * 2, F.col("claimed") + F.col("support")).alias("f1"),
        "support", "tp",
    )


def macro_metrics(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and unweighted class means of precision, recall and F1."""
    return class_report(counts, keys).groupBy(*map(column, keys)).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
    )


def binary_metrics(counts: DataFrame, keys: Sequence[str] = (), positive: object = 1) -> DataFrame:
    """Metrics of the positive class alone."""
    return class_report(counts, keys).where(F.col("class") == F.lit(positive)).drop("class", "tp")


def constant_baseline(counts: DataFrame, keys: Sequence[str] = (), constant: object = 1, zero: object = 0) -> DataFrame:
    """Accuracy, its gain over always answering ``constant``, and count and share of class ``zero``."""
    total = F.sum("n")
    right = F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)) / total
    always = F.sum(F.when(F.col("y") == F.lit(constant), F.col("n")).otherwise(0)) / total
    zeros = F.sum(F.when(F.col("y") == F.lit(zero), F.col("n")).otherwise(0))
    return counts.groupBy(*map(column, keys)).agg(
        right.alias("accuracy"), (right - always).alias("gain"), zeros.alias("n_zero"), (zeros / total).alias("share_zero")
    )


def area_under_roc(
    df: DataFrame, truth: str, score: str, keys: Sequence[str] = (), positive: object = 1, blocks: Blocks | None = None
) -> DataFrame:
    """Area under the ROC curve from mid-ranks; null if a class is missing."""
    positives = F.count_if(column(truth) == F.lit(positive)).alias("_pos")
    ranked = value_counts_ranked(df.where(column(score).isNotNull()), keys, score, [positives], blocks)
    n1, n = F.sum("_pos"), F.sum("ties")
    top = F.sum(F.col("midrank") * F.col("_pos")) - n1 * (n1 + 1) / 2
    return ranked.groupBy(*map(column, keys)).agg(F.try_divide(top, n1 * (n - n1)).alias("auc"))


def long_metrics(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metric columns to rows ``(keys…, metric, value)``."""
    names = [c for c in wide.columns if c not in keys]
    values = wide.select(*map(column, keys), *[column(c).cast("double").alias(c) for c in names])
    return values.unpivot([column(k) for k in keys], [column(c) for c in names], "metric", "value")
