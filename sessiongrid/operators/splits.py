"""Splits by entity. A split is a table ``(entity, fold, split)``; one join applies all folds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongrid.operators.align import join_entities
from sessiongrid.operators.ordered import Blocks, HashBlocks, column, hash_order, row_index
from sessiongrid.operators.sampling import hash_ranked


def split_sizes(n: int) -> tuple[int, int]:
    """Entities in train (70 %, down) and in validation (20 %, up); test has the rest."""
    return math.floor(0.7 * n), math.ceil(0.2 * n)


def _entities(df: DataFrame, entity: str, folds: int) -> tuple[DataFrame, int]:
    entities = df.select(column(entity)).distinct()
    n = entities.count()
    if n < folds:
        raise ValueError(f"{n} entities cannot fill {folds} folds")
    return entities, n


def _named(train: Column, val: Column) -> Column:
    return F.when(train, "train").when(val, "val").otherwise("test")


def rotating_folds(
    df: DataFrame, entity: str, folds: int = 5, seed: int | str = 42, blocks: HashBlocks | None = None
) -> DataFrame:
    """70/20/10 split by entity, rotated by the validation size from fold to fold."""
    entities, n = _entities(df, entity, folds)
    train, val = split_sizes(n)
    placed = hash_ranked(entities, [], [entity], seed, "_p", blocks)
    turned = F.pmod(F.col("_p") - F.col("fold") * val, F.lit(n))
    return (
        placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .withColumn("split", _named(turned < train, turned < train + val))
        .drop("_p")
    )


def reshuffled_folds(
    df: DataFrame, entity: str, folds: int = 5, seed: int = 42, blocks: HashBlocks | None = None
) -> DataFrame:
    """70/20/10 split by entity, shuffled anew with ``seed + fold`` in every fold."""
    entities, n = _entities(df, entity, folds)
    train, val = split_sizes(n)
    each = entities.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    each = each.withColumn("_seed", F.col("fold") + F.lit(seed))
    placed = hash_ranked(each, ["fold"], [entity, "_seed"], "fold", "_p", blocks)
    return placed.withColumn("split", _named(F.col("_p") < train, F.col("_p") < train + val)).drop("_p", "_seed")


def block_folds(
    df: DataFrame, entity: str, folds: int = 5, seed: int = 42, blocks: HashBlocks | None = None
) -> DataFrame:
    """Fold i trains on the i-th run of entities and draws validation from the others at random.

    With a 70 % train size the runs end after the second fold, so later folds have no train rows.
    """
    entities, n = _entities(df, entity, folds)
    train, val = split_sizes(n)
    placed = hash_ranked(entities, [], [entity], seed, "_p", blocks)
    each = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    each = each.withColumn("_train", F.floor(F.col("_p") / F.lit(train)) == F.col("fold"))
    drawn = hash_ranked(each, ["fold", "_train"], [entity, "fold"], f"{seed}|rest", "_q", blocks)
    return drawn.withColumn("split", _named(F.col("_train"), F.col("_q") < val)).drop("_p", "_q", "_train")


def row_folds(df: DataFrame, ids: Sequence[str], folds: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Plain shuffled folds of rows or windows, by hash; no shuffle of data."""
    number = F.conv(F.substring(hash_order(seed, *ids), 1, 8), 16, 10).cast("long")
    return df.withColumn(name, (number % folds).cast("int"))


def within_entity_split(
    df: DataFrame, entity: str, order: Sequence[str], train_share: float, blocks: Blocks | None = None
) -> DataFrame:
    """Per entity the first ``train_share`` of rows train, a fifth of that many validate, the rest test.

    Rows keep their time order, so windows cut later are real windows.
    """
    placed = row_index(df, [entity], order, "_pos", blocks, total="_n")
    train = F.floor(F.col("_n") * F.lit(train_share))
    val = F.floor(train * F.lit(0.2))
    return (
        placed.withColumn("split", _named(F.col("_pos") < train, F.col("_pos") < train + val))
        .drop("_pos", "_n")
    )


def apply_folds(
    df: DataFrame, folds: DataFrame, entity: str, fold: int | None = None, salts: int = 1
) -> DataFrame:
    """Rows with their ``split``, for one fold or for all of them; ``salts`` as in ``join_entities``."""
    chosen = folds if fold is None else folds.where(F.col("fold") == fold)
    return join_entities(df, chosen, [entity], salts)


def require_filled(split: DataFrame) -> DataFrame:
    """Pass the table on if train, val and test all have rows; otherwise an error."""
    found = {r["split"] for r in split.select("split").distinct().collect()}
    empty = sorted({"train", "val", "test"} - found)
    if empty:
        raise ValueError(f"empty splits: {empty}")
    return split
