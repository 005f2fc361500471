"""As-of lookups as one union and one ordered pass: linear work, no pairs.

Both sides go into one table ordered by (time, side), and each left row takes the last (or next)
right row it meets. Ties and strictness are decided by the side number alone. A right side that is measured to be small
is broadcast as an index instead, and the left side is not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.operators.lookup import fits, look_up
from sessiongrid.operators.ordered import Blocks, column, plan_blocks, running


def interleave(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    right_columns, left_side: int, right_side,
) -> DataFrame:
    """One table of left rows (``_left`` true) and right rows, with ``_time`` and ``_side``.

    Times keep their type, or take the common type of both sides if they differ.
    """
    probes = left.withColumns({"_time": column(left_time), "_side": F.lit(left_side), "_left": F.lit(True)})
    found = right.select(
        *[column(k) for k in keys],
        column(right_time).alias("_time"),
        (F.lit(right_side) if isinstance(right_side, int) else right_side).alias("_side"),
        F.lit(False).alias("_left"),
        *right_columns,
    )
    return probes.unionByName(found, allowMissingColumns=True)


def plan_times(left: DataFrame, right: DataFrame, left_time: str, right_time: str) -> Blocks:
    """Blocks of the times of both sides, from nothing but the two time columns."""
    times = left.select(column(left_time).alias("_time"))
    return plan_blocks(times.unionByName(right.select(column(right_time).alias("_time"))), "_time")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    take: Sequence[str],
    direction: str = "backward",
    strict: bool = False,
    tiebreak: str | None = None,
    blocks: Blocks | None = None,
    index: bool | None = None,
) -> DataFrame:
    """Every left row with the ``take`` columns of its nearest right row by time, or nulls.

    backward: the latest right row with ``right_time <= left_time`` (``<`` if strict);
    forward: the earliest right row with ``right_time >= left_time`` (``>`` if strict).
    Among equal right times backward takes the greatest ``tiebreak``, forward the smallest. Rows without a time meet nothing.
    ``index`` broadcasts the right side or not; by default its measured size decides, unless ``blocks`` asks for the pass.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, not {direction}")
    clash = sorted(set(take) & set(left.columns))
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    forward = direction == "forward"
    right_side = 2 if strict != forward else 0
    hit = F.struct(*[column(c) for c in take]).alias("_hit")
    seq = (column(tiebreak) if tiebreak else F.lit(0)).alias("_seq")
    right = right.where(column(right_time).isNotNull())
    if index is None:
        index = blocks is None and fits(right, list(dict.fromkeys([*keys, right_time, *take, *([tiebreak] if tiebreak else [])])))
    if index:
        steps = right.select(*[column(k) for k in keys], column(right_time).alias("_time"), F.lit(right_side).alias("_side"), hit, seq)
        found = look_up(left, steps, keys, left_time, "_hit", right_side, forward, ["_seq"])
        return found.select(*[column(c) for c in left.columns], *[F.col("_hit")[c].alias(c) for c in take])
    both = interleave(left, right, keys, left_time, right_time, [hit, seq], 1, right_side)
    if blocks is None:
        blocks = plan_blocks(both, ["_time", "_side", "_seq"])
    walked = running(
        both, keys, ["_time", "_side", "_seq"], F.col("_hit"), "last", "_hit", blocks, reverse=forward
    )
    timed = F.when(column(left_time).isNotNull(), F.col("_hit"))
    return walked.where("_left").select(
        *[column(c) for c in left.columns], *[timed[c].alias(c) for c in take]
    )
