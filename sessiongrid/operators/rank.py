"""Ranks, ranked cuts, top rows, mid-ranks and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessiongrid.operators.ordered import (
    Blocks, add_carry, block_sizes, carry_first, column, over_neighbours, plan_blocks, row_index,
)
from sessiongrid.session import settle


def ranked_drops(
    features: DataFrame, importance: str = "importance", tiebreak: str = "feature", blocks: Blocks | None = None
) -> DataFrame:
    """Features by falling importance with 0-based ``rank`` and relative change to the next one."""
    turned = features.withColumn("_fall", -column(importance))
    ranked = row_index(turned, [], ["_fall", tiebreak], "rank", blocks)

    def change(window) -> dict[str, Column]:
        return {"importance_drop": F.abs(F.try_divide(column(importance), F.lead(column(importance)).over(window)) - 1)}

    return over_neighbours(
        ranked, [], ["_fall", tiebreak], 0, 1, change, blocks, index="rank"
    ).drop("_fall")


def cut_at_drop(ranked: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Rows ranked before the first drop beyond ``threshold``; all of them if there is none.

    The cut position is one number, read to the driver.
    """
    cut = ranked.agg(F.min(F.when(F.col("importance_drop") > threshold, F.col("rank")))).first()[0]
    return ranked if cut is None else ranked.where(F.col("rank") < cut)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole first row per key by ``order``: a partial aggregate, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*map(column, rest)), F.struct(*map(column, order))).alias("_first")
    found = df.groupBy(*map(column, keys)).agg(pick)
    return found.select(*[column(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


def first_share(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], share: float, blocks: Blocks | None = None
) -> DataFrame:
    """The first ``floor(share · n)`` rows of each group."""
    ranked = row_index(df, keys, order, "_pos", blocks, total="_n")
    return ranked.where(F.col("_pos") < F.floor(F.col("_n") * share)).drop("_pos", "_n")


def long_values(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide features to rows ``(keep…, feature, value)``, missing values left out."""
    values = df.select(*map(column, keep), *[column(f).cast("double").alias(f) for f in features])
    long = values.unpivot([column(k) for k in keep], [column(f) for f in features], "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts_ranked(
    df: DataFrame, keys: Sequence[str], value: str, counts: Sequence[Column] = (), blocks: Blocks | None = None,
    total: str | None = None,
) -> DataFrame:
    """One row per (keys, value): ``ties`` equal values, ``before`` smaller ones, ``midrank``.

    ``total`` adds the number of rows of the group.

    Equal values collapse in a partial aggregate first, whose result is settled; blocks are planned and
    sized on it, so the rows are read once and heavily tied columns stay small.
    """
    key_columns = [column(k) for k in keys]
    # -0.0 and 0.0 tie
    same = df.withColumn(value, column(value) + F.lit(0.0))
    collapsed = settle(same.groupBy(*key_columns, column(value)).agg(F.count(F.lit(1)).alias("ties"), *counts))
    if blocks is None:
        blocks = plan_blocks(collapsed, value)
    distinct = collapsed.withColumn("_block", blocks.number(column(value)))
    within = W.partitionBy(*key_columns, F.col("_block"))
    if blocks.single:
        inside, both = within.orderBy(column(value)), distinct
        every = F.sum("ties").over(inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    else:
        both = add_carry(distinct, block_sizes(distinct, keys, "ties", total, "ties"))
        inside = within.orderBy(carry_first(), column(value))
        every = F.first(total).over(inside.rowsBetween(W.unboundedPreceding, 0)) if total else None
    upto = F.sum("ties").over(inside.rowsBetween(W.unboundedPreceding, 0))
    ranked = both.withColumns({"before": upto - F.col("ties"), **({total: every} if total else {})})
    if not blocks.single:
        ranked = ranked.where(~F.col("_carry"))
    return ranked.withColumn("midrank", F.col("before") + (F.col("ties") + 1) / 2).drop("_block", "_carry")


def midranks(df: DataFrame, keys: Sequence[str], value: str, blocks: Blocks | None = None) -> DataFrame:
    """Distinct values per group with average ranks."""
    return value_counts_ranked(df, keys, value, (), blocks)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], blocks: Blocks | None = None,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """Quantiles with linear interpolation, as one array per group, without gathering a group.

    The two neighbours of each quantile are found among the ranked distinct values (``ranked``,
    if made already, with its total ``_n``).
    """
    if ranked is None:
        ranked = value_counts_ranked(df.where(column(value).isNotNull()), keys, value, (), blocks, total="_n")
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("ties"))
    picks, results = [], []
    for i, share in enumerate(shares):
        at = (F.col("_n") - 1) * F.lit(float(share))
        picks += [
            F.max(F.when(holds(F.floor(at)), column(value))).alias(f"_lo{i}"),
            F.max(F.when(holds(F.ceil(at)), column(value))).alias(f"_hi{i}"),
        ]
        part = at - F.floor(at)
        results.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part)
    return (
        ranked.groupBy(*map(column, keys))
        .agg(*picks, F.max("_n").alias("_n"))
        .select(*map(column, keys), F.array(*results).alias("quantiles"))
    )
