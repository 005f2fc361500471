"""Bring modalities onto one (entity, frame) key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.catalog import numeric_names
from sessiongrid.operators.clean import is_infinite, is_missing
from sessiongrid.operators.ordered import column, row_index


def inner_align(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows present in every table; all joins share the key, so each table shuffles once."""
    return reduce(lambda left, right: left.join(right, list(keys)), tables)


def left_align(base: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(extra, list(keys), "left")


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name, nulls where a table lacks a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def frame_means(df: DataFrame, keys: Sequence[str], fill: str = "zero") -> DataFrame:
    """Mean of every numeric column per key.

    ``fill="zero"`` counts missing and infinite values as 0, as rows blanked outside speech are;
    ``fill="ignore"`` leaves them out.
    """
    if fill not in ("zero", "ignore"):
        raise ValueError(f"fill must be zero or ignore, not {fill}")
    names = [n for n in numeric_names(df) if n not in keys]
    other = F.lit(0.0) if fill == "zero" else F.lit(None)
    means = [
        F.avg(F.when(is_missing(column(n)) | is_infinite(column(n)), other).otherwise(column(n))).alias(n)
        for n in names
    ]
    return df.groupBy(*[column(k) for k in keys]).agg(*means)


def missing_keys(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``expected`` without a partner: unmatched files, unfinished work, set difference."""
    return expected.join(found.select(*[column(k) for k in keys]).distinct(), list(keys), "left_anti")


def keep_entities(df: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(entities.select(*[column(k) for k in keys]), list(keys), "left_semi")


def join_entities(df: DataFrame, per_entity: DataFrame, keys: Sequence[str], salts: int = 1) -> DataFrame:
    """Attach a table with few rows per entity to the rows of a big one.

    Adaptive execution broadcasts a small table and splits skewed partitions. With ``salts`` the
    rows of an entity are spread over that many keys from the start and the small table is copied.
    """
    if salts == 1:
        return df.join(per_entity, list(keys))
    rest = [column(c) for c in df.columns if c not in keys]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    copies = per_entity.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def dense_entity_number(df: DataFrame, entity: str, order: Sequence[str], name: str = "entity_no") -> DataFrame:
    """Attach 0, 1, 2… to entities in order of first appearance by ``order``."""
    first = df.groupBy(column(entity)).agg(F.min(F.struct(*[column(o) for o in order])).alias("_first"))
    spread = first.select(column(entity), *[F.col("_first")[o].alias(f"_o{i}") for i, o in enumerate(order)])
    numbered = row_index(spread, [], [*[f"_o{i}" for i in range(len(order))], entity], name)
    return df.join(numbered.select(column(entity), name), entity)
