"""Counts, shares, cross-tabs and distribution summaries.

All groupings are partial aggregates before the shuffle, so a hot group costs one small row per
input task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongrid.operators.ordered import Blocks, column
from sessiongrid.operators.rank import exact_quantiles, value_counts_ranked


def label_shares(df: DataFrame, keys: Sequence[str], label: str, classes: Sequence[int]) -> DataFrame:
    """Per entity ``n_<class>``, ``pct_<class>`` (one decimal) and ``total``."""
    counts = [F.count_if(column(label) == c).alias(f"n_{c}") for c in classes]
    grouped = df.groupBy(*map(column, keys)).agg(*counts, F.count(F.lit(1)).alias("total"))
    shares = {f"pct_{c}": F.round(F.col(f"n_{c}") * 100 / F.col("total"), 1) for c in classes}
    return grouped.withColumns(shares)


def value_counts(df: DataFrame, *names: str) -> DataFrame:
    return df.groupBy(*map(column, names)).agg(F.count(F.lit(1)).alias("n"))


def crosstab(
    df: DataFrame, row: str, col: str, rows: Sequence, cols: Sequence, percent: bool = False
) -> DataFrame:
    """Counts with fixed rows and columns, 0 where absent; ``percent`` divides by the row sum."""
    counts = [F.count_if(column(col).eqNullSafe(F.lit(c))).alias(str(c)) for c in cols]
    table = df.where(column(row).isin(*rows)).groupBy(column(row)).agg(*counts)
    every = df.sparkSession.createDataFrame([(r,) for r in rows], [row]).select(
        column(row).cast(df.schema[row].dataType).alias(row)
    )
    full = every.join(table, row, "left").na.fill(0)
    if not percent:
        return full
    total = sum((column(str(c)) for c in cols[1:]), column(str(cols[0])))
    return full.select(
        column(row), *[F.when(total > 0, column(str(c)) * 100 / total).alias(str(c)) for c in cols]
    )


def positive_confidence(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per entity and keypoint: number and mean of positive confidences, 0 if none."""
    stats = [
        F.struct(
            F.lit(c).alias("keypoint"),
            F.count_if(column(c) > 0).alias("n_positive"),
            F.coalesce(F.avg(F.when(column(c) > 0, column(c))), F.lit(0.0)).alias("mean_positive"),
        )
        for c in columns
    ]
    return df.groupBy(*map(column, keys)).agg(F.array(*stats).alias("_s")).select(*map(column, keys), F.inline("_s"))


def compound_confidence(per_keypoint: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over keypoints of their mean confidences."""
    return per_keypoint.groupBy(*map(column, keys)).agg(F.avg("mean_positive").alias("compound"))


def low_confidence_percent(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], cut: float = 0.5
) -> DataFrame:
    """Percent of positive confidences below ``cut``, null when none is positive."""
    positive = sum((F.count_if(column(c) > 0) for c in columns[1:]), F.count_if(column(columns[0]) > 0))
    low = [F.count_if((column(c) > 0) & (column(c) < cut)) for c in columns]
    share = F.when(positive > 0, sum(low[1:], low[0]) * 100 / positive)
    return df.groupBy(*map(column, keys)).agg(share.alias("pct_low"))


def reliable_entities(compound: DataFrame, cut: float = 0.5) -> DataFrame:
    """Entities that are not excluded for low confidence."""
    return compound.where(F.col("compound") >= cut)


def majority_class(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent class per group, the smallest on ties."""
    counts = value_counts(df, *keys, label)
    return counts.groupBy(*map(column, keys)).agg(
        F.min_by(column(label), F.struct(-F.col("n"), column(label))).alias("majority"), F.max("n").alias("n")
    )


def smallest_class_size(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return value_counts(df, *keys, label).groupBy(*map(column, keys)).agg(F.min("n").alias("n_min"))


def class_bars(df: DataFrame, label: str, value: str) -> DataFrame:
    """Mean and sample sd per class."""
    return df.groupBy(column(label)).agg(F.avg(column(value)).alias("mean"), F.stddev_samp(column(value)).alias("sd"))


def group_moments(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Size, skewness and excess kurtosis per group and feature, one pass over the wide table."""
    stats = [
        F.struct(
            F.lit(f).alias("feature"),
            F.count(column(f)).alias("n"),
            F.skewness(column(f)).alias("skewness"),
            F.kurtosis(column(f)).alias("kurtosis"),
        )
        for f in features
    ]
    return df.groupBy(column(group)).agg(F.array(*stats).alias("_s")).select(column(group), F.inline("_s"))


def box_stats(
    df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5, blocks: Blocks | None = None
) -> DataFrame:
    """Quartiles and whiskers (furthest values within ``reach`` times the quartile range)."""
    ranked = value_counts_ranked(df.where(column(value).isNotNull()), keys, value, (), blocks, total="_n")
    quartiles = exact_quantiles(df, keys, value, (0.25, 0.5, 0.75), blocks, ranked).select(
        *map(column, keys), *[F.get("quantiles", i).alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    )
    low = F.col("q1") - (F.col("q3") - F.col("q1")) * reach
    high = F.col("q3") + (F.col("q3") - F.col("q1")) * reach
    inside = ranked.join(quartiles, list(keys)).where(column(value).between(low, high))
    return inside.groupBy(*map(column, keys), "q1", "median", "q3").agg(
        F.min(column(value)).alias("whisker_low"), F.max(column(value)).alias("whisker_high")
    )


def kde_grid(
    df: DataFrame, group: str, value: str, low: float, high: float, points: int = 100,
    bin_width: float | None = None,
) -> DataFrame:
    """Gaussian density per group at evenly spaced points, Scott bandwidth, each group summing to 1.

    Equal values collapse to a weight first; ``bin_width`` also collapses near values onto bin
    centres, which bounds the work by bins × points whatever the number of rows.
    """
    v = column(value).cast("double")
    spot = v if bin_width is None else (F.floor(v / bin_width) + 0.5) * bin_width
    usable = df.where(v.isNotNull())
    width = usable.groupBy(column(group)).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.stddev_samp(v) * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("_h"),
    )
    weights = usable.groupBy(column(group), spot.alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
    step = (high - low) / (points - 1)
    x = F.lit(low) + F.col("point") * F.lit(step)
    z = F.try_divide(x - F.col("_v"), F.col("_h"))
    bump = F.try_divide(F.col("_w") * F.exp(-z * z / 2), F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))
    return (
        weights.join(width, group)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(column(group), "point")
        .agg(F.sum(bump).alias("density"))
        .withColumn("x", x)
    )


def fold_summary(metrics: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and population sd of a metric over folds."""
    return metrics.groupBy(*map(column, keys)).agg(
        F.avg(column(value)).alias("mean"), F.stddev_pop(column(value)).alias("sd")
    )


def best_epoch(
    curve: DataFrame, keys: Sequence[str] = (), epoch: str = "epoch", value: str = "value", first_epoch: int = 30
) -> DataFrame:
    """Epoch from ``first_epoch`` on with the greatest fold mean; ties go to the later epoch."""
    means = curve.groupBy(*map(column, keys), column(epoch)).agg(F.avg(column(value)).alias("mean"))
    return (
        means.where(column(epoch) >= first_epoch)
        .groupBy(*map(column, keys))
        .agg(
            F.max_by(column(epoch), F.struct("mean", column(epoch))).alias("best_epoch"),
            F.max("mean").alias("best_mean"),
        )
    )


def file_average(metrics: DataFrame, file: str, metric: str, value: str, mode: str = "mean") -> DataFrame:
    """Average of metrics read from files: the plain mean, or ``per_file`` (sum over file count)."""
    grouped = metrics.groupBy(column(metric))
    if mode == "mean":
        return grouped.agg(F.avg(column(value)).alias("average"))
    if mode != "per_file":
        raise ValueError(f"mode must be mean or per_file, not {mode}")
    files = metrics.select(F.count_distinct(column(file))).first()[0]
    return grouped.agg((F.sum(column(value)) / F.lit(files)).alias("average"))


def feature_family_counts(features: DataFrame, name: str, families: dict[str, str]) -> DataFrame:
    """Number of features per family; the first matching pattern wins, else ``other``."""
    family: Column | None = None
    for label, pattern in families.items():
        test = column(name).rlike(pattern)
        family = F.when(test, label) if family is None else family.when(test, label)
    return features.groupBy(family.otherwise("other").alias("family")).agg(F.count(F.lit(1)).alias("n"))


def interaction_start(annotations: DataFrame, keys: Sequence[str], start: str = "start") -> DataFrame:
    return annotations.groupBy(*map(column, keys)).agg(F.min(column(start)).alias("start"))
