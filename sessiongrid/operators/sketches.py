"""Quantiles from mergeable sketches, for tables and histories too large for exact ranks.

A sketch per (keys, feature) is a few kilobytes whatever the number of rows; sketches of parts, say of days, are stored
and merged later, without the rows. The normalised rank of a quantile from a sketch is off by at most ``error``: its
size is chosen so that twice its own 99 % bound fits into that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.operators.ordered import column

ERROR = 0.01
QUARTILES = (0.25, 0.5, 0.75)
# Rank error of such a sketch of size k at 99 %, and the sizes that Spark allows.
BOUND_FACTOR, BOUND_POWER = 2.296, 0.9723
SMALLEST, LARGEST = 8, 65_535


def sketch_size(error: float = ERROR) -> int:
    """The size whose 99 % bound of the normalised rank error is half of ``error``."""
    size = int((BOUND_FACTOR / (error / 2)) ** (1 / BOUND_POWER)) + 1
    if size > LARGEST:
        raise ValueError(f"no sketch is as sharp as {error}; take exact quantiles")
    return max(SMALLEST, size)


def value_sketches(df: DataFrame, keys: Sequence[str], features: Sequence[str], error: float = ERROR) -> DataFrame:
    """``keys, feature, n, low, high, sketch``, one pass over the wide table; missing and non-finite values are left out.

    A group without values has n = 0 and nulls.
    """
    size = sketch_size(error)
    rows = []
    for name in features:
        value = column(name).cast("double")
        usable = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)
        n = F.count(usable)
        rows.append(F.struct(
            F.lit(name).alias("feature"), n.alias("n"), F.min(usable).alias("low"), F.max(usable).alias("high"),
            F.when(n > 0, F.kll_sketch_agg_double(usable, size)).alias("sketch"),
        ))
    return df.groupBy(*map(column, keys)).agg(F.array(*rows).alias("_s")).select(*map(column, keys), F.inline("_s"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of parts (further key columns) as one a group; the parts' rows are not needed."""
    return sketches.groupBy(*map(column, keys), "feature").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"),
    ).withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def sketch_quantiles(sketches: DataFrame, shares: Sequence[float] = QUARTILES) -> DataFrame:
    """The sketches with an array ``quantiles``."""
    asked = F.array(*[F.lit(float(s)) for s in shares])
    return sketches.withColumn("quantiles", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", asked)))


def sketched_box_stats(df: DataFrame, sketches: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles from sketches of ``value``, and whiskers: the furthest values of ``df`` within ``reach`` quartile ranges.

    The quartiles are a row a group; the rows are read once more and only two numbers a group are kept of them.
    """
    found = sketch_quantiles(sketches.where((F.col("feature") == value) & (F.col("n") > 0)))
    quartiles = found.select(*map(column, keys), *[F.get("quantiles", i).alias(name) for i, name in enumerate(("q1", "median", "q3"))])
    spread = (F.col("q3") - F.col("q1")) * reach
    inside = df.join(quartiles, list(keys)).where(column(value).between(F.col("q1") - spread, F.col("q3") + spread))
    return inside.groupBy(*map(column, keys), "q1", "median", "q3").agg(
        F.min(column(value)).alias("whisker_low"), F.max(column(value)).alias("whisker_high")
    )


def rank_errors(df: DataFrame, sketches: DataFrame, keys: Sequence[str], features: Sequence[str], shares: Sequence[float] = QUARTILES) -> DataFrame:
    """``keys, feature, share, quantile, error``: how far each quantile's true ranks in ``df`` are from the share.

    A value that stands for several ranks has the error of the nearest of them. One pass counts the values below and up to each quantile.
    """
    found = sketch_quantiles(sketches, shares).where(F.col("n") > 0)
    wide = found.groupBy(*map(column, keys)).agg(F.map_from_entries(F.collect_list(F.struct("feature", "quantiles"))).alias("_q"))
    counts = []
    for name in features:
        value = column(name).cast("double")
        for i, share in enumerate(shares):
            q = F.get(F.col("_q")[name], i)
            n = F.count(F.when(q.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value))
            low, high = F.count_if(value < q) / n, F.count_if(value <= q) / n
            error = F.greatest(F.lit(0.0), low - F.lit(share), F.lit(share) - high)
            counts.append(F.struct(F.lit(name).alias("feature"), F.lit(share).alias("share"), F.first(q).alias("quantile"), F.when(n > 0, error).alias("error")))
    return df.join(wide, list(keys)).groupBy(*map(column, keys)).agg(F.array(*counts).alias("_e")).select(*map(column, keys), F.inline("_e")).where(F.col("error").isNotNull())
