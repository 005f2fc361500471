"""Repeatable shuffles and class balancing. "Random" is the order of a hash of the row's key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.operators.align import join_entities
from sessiongrid.operators.ordered import HashBlocks, column, hash_blocks_for, hash_order, plan_hash_blocks, row_index


def hash_ranked(
    df: DataFrame, groups: Sequence[str], ids: Sequence[str], seed: int | str, name: str = "_pos",
    blocks: HashBlocks | None = None,
) -> DataFrame:
    """Position of each row in the shuffled order of its group; ``ids`` identify a row."""
    shuffled = df.withColumn("_shuffle", hash_order(seed, *ids))
    if blocks is None:
        blocks = plan_hash_blocks(df)
    return row_index(shuffled, groups, ["_shuffle", *ids], name, blocks).drop("_shuffle")


def undersample_to_smallest(
    df: DataFrame, label: str, ids: Sequence[str], keys: Sequence[str] = (), seed: int | str = 42,
    blocks: HashBlocks | None = None, salts: int = 1,
) -> DataFrame:
    """Each class cut to the size of the smallest one, per entity if ``keys`` are given."""
    ranked = hash_ranked(df, [*keys, label], ids, seed, "_pos", blocks)
    sizes = df.groupBy(*map(column, keys), column(label)).agg(F.count(F.lit(1)).alias("_n"))
    smallest = sizes.groupBy(*map(column, keys)).agg(F.min("_n").alias("_least"))
    if keys:
        limited = join_entities(ranked, smallest, keys, salts)
    else:
        limited = ranked.withColumn("_least", F.lit(smallest.first()["_least"]))
    return limited.where(F.col("_pos") < F.col("_least")).drop("_pos", "_least")


def class_sizes(df: DataFrame, label: str) -> dict:
    """Rows per class: a table as short as the list of classes."""
    return {r[label]: r["n"] for r in df.groupBy(column(label)).agg(F.count(F.lit(1)).alias("n")).collect()}


def resample_to(
    df: DataFrame, label: str, targets: Mapping[object, int], ids: Sequence[str], seed: int | str = 42,
    blocks: HashBlocks | None = None, sizes: Mapping[object, int] | None = None,
) -> DataFrame:
    """Classes named in ``targets`` brought to that many rows; other classes stay as they are.

    A class with n rows and target T repeats every row ``T div n`` times and the first
    ``T mod n`` rows of its shuffled order once more, so growing and cutting are one rule.
    Copies are numbered by ``copy``.
    """
    if sizes is None:
        sizes = class_sizes(df, label)
    if blocks is None:
        blocks = hash_blocks_for(sum(sizes.values()))
    ranked = hash_ranked(df, [label], ids, seed, "_pos", blocks)
    copies = F.lit(1)
    for value, target in targets.items():
        n = sizes.get(value)
        if n:
            wanted = F.lit(target // n) + F.when(F.col("_pos") < target % n, 1).otherwise(0)
            copies = F.when(column(label) == F.lit(value), wanted).otherwise(copies)
    return (
        ranked.withColumn("_copies", copies)
        .where(F.col("_copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .drop("_pos", "_copies")
    )


def oversample_to_largest(df: DataFrame, label: str, ids: Sequence[str], seed: int | str = 42) -> DataFrame:
    sizes = class_sizes(df, label)
    return resample_to(df, label, dict.fromkeys(sizes, max(sizes.values())), ids, seed, sizes=sizes)
