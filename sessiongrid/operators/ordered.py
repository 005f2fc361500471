"""Ordered operations that stay parallel when one entity holds most of the rows.

A plain ``Window.partitionBy(entity)`` sends a whole entity to one task. Here the order column is
cut into blocks, the window runs per (entity, block), and what a block needs from its neighbours
comes from a small per-block summary (counts, last values, sums) or from a halo of copied rows.
Blocks are quantiles of the order columns over *all* rows, so a group of (entity, block) holds at
most about ``rows_per_block`` rows whatever the entity sizes are. Cuts compare all order columns in
their own types, so text, dates and timestamps work at any size and ties in the first column split.
A table that fits in one block takes the plain window.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 2_000_000
#: sampled rows per cut; the size of a block varies by about its inverse square root
SAMPLED_PER_BLOCK = 40


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str | Column) -> Column:
    return F.col(quoted(name)) if isinstance(name, str) else name


@dataclass(frozen=True)
class Blocks:
    """Ascending cut points of the leading order columns; block ``i`` lies after ``i`` cuts.

    A cut is a tuple of the columns' values as text, ``kinds`` their Spark types; a plain number cuts
    the first column as a double.
    """

    cuts: tuple = ()
    kinds: tuple[str, ...] = ("double",)

    @property
    def single(self) -> bool:
        return not self.cuts

    def number(self, *order: Column) -> Column:
        """Block of the order columns' values, so that blocks follow the order: a binary search."""
        if self.single:
            return F.lit(0)
        names = [f"c{i}" for i in range(len(self.kinds))]
        rows = [cut if isinstance(cut, tuple) else (cut,) for cut in self.cuts]
        text = json.dumps([{n: None if v is None else str(v) for n, v in zip(names, row)} for row in rows])
        as_text = "array<struct<" + ", ".join(f"{n}: string" for n in names) + ">>"
        typed = "array<struct<" + ", ".join(f"{n}: {k}" for n, k in zip(names, self.kinds)) + ">>"
        cuts = F.sort_array(F.from_json(F.lit(text), as_text).cast(typed))
        value = F.struct(*[c.cast(k).alias(n) for c, k, n in zip(order, self.kinds, names)])
        bounds = F.struct(F.lit(0).alias("lo"), F.lit(len(rows)).alias("hi"))

        def halve(b: Column, _: Column) -> Column:
            middle = F.shiftright(b["lo"] + b["hi"], 1)
            right = (b["lo"] < b["hi"]) & (F.get(cuts, middle) < value)
            return F.struct(
                F.when(right, middle + 1).otherwise(b["lo"]).alias("lo"),
                F.when(right, b["hi"]).otherwise(middle).alias("hi"),
            )

        steps = F.sequence(F.lit(1), F.lit(len(rows).bit_length()))
        return F.aggregate(steps, bounds, halve, lambda b: b["lo"])


@dataclass(frozen=True)
class HashBlocks:
    """Blocks of a hexadecimal hash column: its first digits are even by construction."""

    digits: int = 0

    @property
    def single(self) -> bool:
        return self.digits == 0

    def number(self, order: Column, *_: Column) -> Column:
        if self.single:
            return F.lit(0)
        return F.conv(F.substring(order, 1, self.digits), 16, 10).cast("long")


def plan_blocks(df: DataFrame, order: str | Column | Sequence[str | Column], rows_per_block: int = ROWS_PER_BLOCK) -> Blocks:
    """Cut points of the ``order`` columns giving about ``rows_per_block`` rows per block over the table.

    Costs a count, and for a table beyond one block one more pass over the order columns, of which
    SAMPLED_PER_BLOCK rows per block reach the driver.
    """
    columns = [column(o) for o in ([order] if isinstance(order, (str, Column)) else order)]
    rows = df.count()
    blocks = math.ceil(rows / rows_per_block)
    if blocks <= 1:
        return Blocks()
    keys = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    share = min(1.0, SAMPLED_PER_BLOCK * blocks / rows)
    sample = keys if share == 1.0 else keys.sample(share, seed=17)
    found = sample.orderBy(*keys.columns).select(*[F.col(c).cast("string") for c in keys.columns]).collect()
    cuts = dict.fromkeys(tuple(found[len(found) * i // blocks]) for i in range(1, blocks)) if found else {}
    return Blocks(tuple(cuts), tuple(f.dataType.simpleString() for f in keys.schema.fields))


def plan_hash_blocks(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> HashBlocks:
    """Number of leading hash digits giving about ``rows_per_block`` rows per block."""
    return hash_blocks_for(df.count(), rows_per_block)


def hash_blocks_for(rows: int, rows_per_block: int = ROWS_PER_BLOCK) -> HashBlocks:
    wanted = rows / rows_per_block
    return HashBlocks(0 if wanted <= 1 else math.ceil(math.log(wanted, 16)))


def add_carry(df: DataFrame, carried: DataFrame) -> DataFrame:
    """Put each block's carried values in front of its rows, as a row of their own.

    A window over (keys, block) in the order of :func:`carry_first` then starts from them. So
    there is no join, one shuffle serves carry and window, and null keys need no care.
    """
    return df.withColumn("_carry", F.lit(False)).unionByName(
        carried.withColumn("_carry", F.lit(True)), allowMissingColumns=True
    )


def carry_first() -> Column:
    return F.col("_carry").desc()


def block_sizes(cut: DataFrame, keys: Sequence[str], base: str, total: str | None = None, weight: str | None = None) -> DataFrame:
    """Rows (or the sum of ``weight``) of the group in earlier blocks, and in all blocks, per (keys, block)."""
    in_order = W.partitionBy(*map(column, keys)).orderBy("_block")
    before = F.coalesce(F.sum("_size").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("_size").over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return (
        cut.groupBy(*map(column, keys), "_block")
        .agg((F.sum(column(weight)) if weight else F.count(F.lit(1))).alias("_size"))
        .select(*map(column, keys), "_block", before.alias(base), *([every.alias(total)] if total else []))
    )


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "idx",
    blocks: Blocks | HashBlocks | None = None,
    total: str | None = None,
) -> DataFrame:
    """Zero-based position of each row within ``keys`` by ``order`` (make ``order`` unique).

    ``total`` adds the number of rows of the group, which saves a join by group.
    """
    if blocks is None:
        blocks = plan_blocks(df, order)
    by = [column(o) for o in order]
    if blocks.single:
        group = W.partitionBy(*map(column, keys))
        added = {name: F.row_number().over(group.orderBy(*by)).cast("long") - 1}
        if total:
            whole = group.orderBy(*by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            added[total] = F.count(F.lit(1)).over(whole)
        return df.withColumns(added)
    cut = df.withColumn("_block", blocks.number(*by))
    both = add_carry(cut.withColumn("_one", F.lit(1).cast("long")), block_sizes(cut, keys, "_one", total))
    window = W.partitionBy(*map(column, keys), F.col("_block")).orderBy(carry_first(), *by)
    so_far = window.rowsBetween(W.unboundedPreceding, 0)
    added = {name: F.sum("_one").over(so_far) - 1}
    if total:
        added[total] = F.first(total).over(so_far)
    return both.withColumns(added).where(~F.col("_carry")).drop("_block", "_one", "_carry")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    how: str,
    name: str,
    blocks: Blocks | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Inclusive running ``last`` (non-null), ``max``, ``min`` or ``sum`` of ``value`` per ``keys``.

    ``reverse`` runs from the end, so ``last`` gives the next non-null value.
    """
    if blocks is None:
        blocks = plan_blocks(df, order)
    folds = {
        "last": lambda c: F.last(c, ignorenulls=True),
        "max": F.max,
        "min": F.min,
        "sum": F.sum,
    }
    fold = folds[how]
    key_columns = [column(k) for k in keys]
    by = [column(o).desc() if reverse else column(o).asc() for o in order]
    if blocks.single:
        window = W.partitionBy(*key_columns).orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(name, fold(value).over(window))

    cut = df.withColumn("_block", blocks.number(*[column(o) for o in order])).withColumn("_value", value)
    if how == "last":
        position = F.when(F.col("_value").isNotNull(), F.struct(*[column(o) for o in order]))
        pick = F.min_by if reverse else F.max_by
        summary = pick("_value", position)
    else:
        summary = fold(F.col("_value"))
    block_order = F.col("_block").desc() if reverse else F.col("_block").asc()
    earlier = W.partitionBy(*key_columns).orderBy(block_order).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*key_columns, "_block")
        .agg(summary.alias("_value"))
        .select(*key_columns, "_block", fold(F.col("_value")).over(earlier).alias("_value"))
        .where(F.col("_value").isNotNull())
    )
    inside = W.partitionBy(*key_columns, F.col("_block")).orderBy(carry_first(), *by)
    folded = fold(F.col("_value")).over(inside.rowsBetween(W.unboundedPreceding, 0))
    walked = add_carry(cut, carried).withColumn("_folded", folded).where(~F.col("_carry"))
    return walked.withColumn(name, F.col("_folded")).drop("_block", "_value", "_carry", "_folded")


def over_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    columns,
    blocks: Blocks | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    index: str | None = None,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``columns(window)`` gets an ordered, partitioned window without a frame and returns
    ``{name: Column}``. In blocks the window runs on row-number blocks that carry a halo of
    copied rows, so the added cost is a ``(before + after) / rows_per_block`` share of the rows.
    ``index`` names a zero-based dense position column if the table has one already.
    """
    key_columns = [column(k) for k in keys]
    if blocks is None:
        blocks = plan_blocks(df, order, rows_per_block)
    if blocks.single:
        window = W.partitionBy(*key_columns).orderBy(*[column(o) for o in order])
        return df.withColumns(columns(window))
    if max(before, after) > rows_per_block:
        rows_per_block = max(before, after)
    indexed = df if index else row_index(df, keys, order, "_idx", blocks)
    position = column(index or "_idx")
    home = F.floor(position / rows_per_block).cast("long")
    first = F.floor(F.greatest(position - after, F.lit(0)) / rows_per_block).cast("long")
    last = F.floor((position + before) / rows_per_block).cast("long")
    copies = indexed.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(first, last)))
    window = W.partitionBy(*key_columns, F.col("_block")).orderBy(position)
    added = copies.withColumns(columns(window)).where(F.col("_home") == F.col("_block"))
    return added.drop("_home", "_block", "_idx")


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    """A repeatable random order: the md5 text of the keys and a seed, the same in any engine."""
    parts = [column(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
