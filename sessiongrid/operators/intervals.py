"""Interval predicates, labels and lookups.

No operator here pairs points with intervals. Containment is a running maximum of interval ends;
"which interval wins at this time" is first solved on the interval side alone, as a step function.
The steps are then looked up: in a broadcast index if they are measured to be small (:mod:`lookup`), so that points
stay where they lie, else by an as-of pass over both sides. ``index`` forces one or the other; ``blocks`` asks for the pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessiongrid.operators.asof import asof_join, interleave, plan_times
from sessiongrid.operators.lookup import INDEX_BYTES, fits, look_up, winners
from sessiongrid.operators.ordered import Blocks, column, over_neighbours, plan_blocks, row_index, running


def mark_contained(
    rows: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    interval_start: str = "start",
    interval_end: str = "end",
    name: str = "contained",
    half_open: bool = False,
    blocks: Blocks | None = None,
    index: bool | None = None,
) -> DataFrame:
    """Flag rows whose ``[start, end]`` lies inside at least one interval of the same keys.

    Some interval contains the row exactly if the greatest end among intervals starting at or
    before the row's start reaches the row's end. ``half_open`` asks ``end < interval_end``.
    """
    reach = column(interval_end).alias("_reach")
    usable = intervals.where(column(interval_start) <= column(interval_end))
    if index is None:
        index = blocks is None and fits(usable, [*keys, interval_start, interval_end])
    if index:
        ends = usable.groupBy(*map(column, keys), column(interval_start).alias("_time")).agg(F.max(column(interval_end)).alias("_end"))
        so_far = W.partitionBy(*map(column, keys)).orderBy("_time").rowsBetween(W.unboundedPreceding, 0)
        steps = ends.select(*map(column, keys), "_time", F.lit(0).alias("_side"), F.max("_end").over(so_far).alias("_hit"))
        found = look_up(rows, steps, keys, start, "_reach", side=0)
        reached = F.col("_reach") > column(end) if half_open else F.col("_reach") >= column(end)
        return found.select(*[column(c) for c in rows.columns], F.coalesce(reached, F.lit(False)).alias(name))
    both = interleave(rows, usable, keys, start, interval_start, [reach], 1, 0)
    if blocks is None:
        blocks = plan_times(rows, usable, start, interval_start)
    walked = running(both, keys, ["_time", "_side"], F.col("_reach"), "max", "_reach", blocks)
    reached = F.col("_reach") > column(end) if half_open else F.col("_reach") >= column(end)
    return walked.where("_left").select(
        *[column(c) for c in rows.columns], F.coalesce(reached, F.lit(False)).alias(name)
    )


def keep_contained(
    rows: DataFrame, intervals: DataFrame, keys: Sequence[str], start: str, end: str,
    values: Sequence[str], **options,
) -> DataFrame:
    """Rows outside every interval keep their keys and times but lose ``values``."""
    marked = mark_contained(rows, intervals, keys, start, end, name="_inside", **options)
    blanked = {v: F.when(F.col("_inside"), column(v)) for v in values}
    return marked.withColumns(blanked).drop("_inside")


def binary_label(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str,
    name: str = "binary_label", **options,
) -> DataFrame:
    """1 where the time lies in some interval, both ends included, else 0."""
    marked = mark_contained(points, intervals, keys, time, time, name="_inside", **options)
    return marked.withColumn(name, F.col("_inside").cast("int")).drop("_inside")


def mask_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str,
    values: Sequence[str] | None = None, **options,
) -> DataFrame:
    """Remove points inside any ``[start, end)``; with ``values`` keep them and null those columns."""
    marked = mark_contained(points, intervals, keys, time, time, name="_inside", half_open=True, **options)
    if values is None:
        return marked.where(~F.col("_inside")).drop("_inside")
    nulled = {v: F.when(~F.col("_inside"), column(v)) for v in values}
    return marked.withColumns(nulled).drop("_inside")


def boundaries_to_intervals(
    boundaries: DataFrame, keys: Sequence[str], errors: str = "errors"
) -> DataFrame:
    """An array of boundaries ``[b0, b1, …]`` per entity to rows ``(k, start, end)`` with k from 1.

    Interval k runs from boundary k-1 to boundary k, so neighbours share a bound.
    """
    b = column(errors)
    pairs = F.transform(
        F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))),
        lambda end, i: F.struct(
            (i + 1).alias("k"), F.get(b, i).alias("start"), end.alias("end")
        ),
    )
    return boundaries.select(*map(column, keys), F.inline(pairs))


def consecutive_intervals(
    events: DataFrame, keys: Sequence[str], time: str, blocks: Blocks | None = None
) -> DataFrame:
    """Rows ``(k, start, end)`` between neighbouring boundary rows of an entity, k from 1."""
    if blocks is None:
        blocks = plan_blocks(events, time)
    numbered = row_index(events, keys, [time], "_n", blocks)

    def following(window: W) -> dict[str, Column]:
        return {"_end": F.lead(column(time)).over(window), "_next": F.lead("_n").over(window)}

    paired = over_neighbours(numbered, keys, [time], 0, 1, following, blocks, index="_n")
    return paired.where(F.col("_next").isNotNull()).select(
        *map(column, keys), F.col("_next").cast("int").alias("k"), column(time).alias("start"), F.col("_end").alias("end")
    )


WIDE_LEVEL = 12
WIDE_COPIES = 256
#: lookups of pieces in spans that one task sorts and joins
LOOKUPS_PER_TASK = 1_000_000


def _lookup_tasks(usable: DataFrame, keys: Sequence[str]) -> int:
    """Tasks for the lookups of :func:`winning_steps`: their number follows from the intervals of each entity, at most two pieces an end."""
    n = F.count(F.lit(1)).cast("double")
    of_entity = usable.groupBy(*map(column, keys)).agg((4 * n * (F.ceil(F.log2(4 * n + 2)) + 1)).alias("_n"))
    return math.ceil((of_entity.agg(F.sum("_n")).first()[0] or 0) / LOOKUPS_PER_TASK)


def _aligned_spans(low: Column, high: Column) -> Column:
    """Cover the whole numbers low..high by few spans of 2^level numbers aligned at 2^level."""
    levels = F.sequence(F.lit(0), F.ceil(F.log2((high - low + 2).cast("double"))).cast("int"))

    def spans(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        first = F.ceil(low / size).cast("long")
        stop = F.floor((high + 1) / size).cast("long")
        left = F.when((first < stop) & (first % 2 == 1), F.struct(level.alias("level"), first.alias("span")))
        right = F.when((first < stop) & (stop % 2 == 1), F.struct(level.alias("level"), (stop - 1).alias("span")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(levels, spans))


def winning_steps(
    intervals: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    priority: str,
    take: Sequence[str],
    pick: str = "last",
    blocks: Blocks | None = None,
) -> DataFrame:
    """The step function "which interval wins at time t", both ends included.

    Per entity the distinct ends cut the time axis into pieces: each end itself and the open gap
    behind it. An interval covers a run of pieces, which splits into O(log n) aligned spans; one
    winner is kept per span before anything else, and a piece looks up the O(log n) spans above
    it. So the work is n log n however deeply the intervals overlap.

    Returns ``keys, _time, _side, take…``: side 0 rules at ``_time``, side 2 just after it.
    """
    if pick not in ("first", "last"):
        raise ValueError(f"pick must be first or last, not {pick}")
    best = F.min if pick == "first" else F.max
    key_columns = [column(k) for k in keys]
    usable = intervals.where(column(start) <= column(end))
    bounds = usable.select(*key_columns, F.explode(F.array(column(start), column(end))).alias("_time")).distinct()
    places = row_index(bounds, keys, ["_time"], "_place", blocks, total="_size")
    spots_of = places.drop("_size")

    spots = (
        usable.select(*key_columns, column(start).alias("_s"), column(end).alias("_e"), column(priority).alias("_p"))
        .join(spots_of.withColumnsRenamed({"_time": "_s", "_place": "_low"}), [*keys, "_s"])
        .join(spots_of.withColumnsRenamed({"_time": "_e", "_place": "_high"}), [*keys, "_e"])
    )
    spans = (
        spots.select(*key_columns, "_p", F.inline(_aligned_spans(F.col("_low") * 2, F.col("_high") * 2)))
        .groupBy(*key_columns, "level", "span")
        .agg(best("_p").alias("_p"))
    )
    # a wide span is asked for by many pieces: its few rows are copied so that no key stays hot
    copies = F.sequence(F.lit(0), F.when(F.col("level") >= WIDE_LEVEL, WIDE_COPIES - 1).otherwise(0))
    spread = spans.withColumn("_copy", F.explode(copies))
    depth = F.ceil(F.log2(F.col("_size").cast("double") * 2 + 2)).cast("int")
    pieces = places.select(
        *key_columns, "_time", "_place", depth.alias("_depth"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_open")
    )
    copy = F.when(F.col("level") >= WIDE_LEVEL, F.col("_place") % WIDE_COPIES).otherwise(0).cast("int")
    probes = (
        pieces.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_depth"))))
        .withColumn("span", F.floor((F.col("_place") * 2 + F.col("_open")) / F.pow(F.lit(2.0), F.col("level"))))
        .withColumn("_copy", copy)
    )
    place = [*keys, "level", "span", "_copy"]
    tasks = _lookup_tasks(usable, keys)
    if tasks > 1:  # lookups compress well, so tasks cut by the size of the shuffle would hold too many
        tasks = max(tasks, int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        probes, spread = (df.repartition(tasks, *map(column, place)) for df in (probes, spread))
    looked = (
        probes.join(spread, place, "left")
        .groupBy(*key_columns, "_time", "_open")
        .agg(best("_p").alias("_p"))
    )
    payload = usable.select(*key_columns, column(priority).alias("_p"), F.struct(*map(column, take)).alias("_take"))
    return looked.join(payload, [*keys, "_p"], "left").select(
        *key_columns, "_time", (F.col("_open") * 2).alias("_side"), *[F.col("_take")[c].alias(c) for c in take]
    )


def lookup_interval(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    end: str,
    priority: str,
    take: Sequence[str],
    pick: str = "last",
    blocks: Blocks | None = None,
    index: bool | None = None,
) -> DataFrame:
    """Each point with the ``take`` columns of the first or last matching interval, or nulls.

    ``priority`` is unique per entity; both interval ends are included.
    """
    if pick not in ("first", "last"):
        raise ValueError(f"pick must be first or last, not {pick}")
    if index is None:
        index = blocks is None and fits(intervals, list(dict.fromkeys([*keys, start, end, priority, *take])), INDEX_BYTES // 2)
    if index:
        found = look_up(points, winners(intervals, keys, start, end, priority, take, pick), keys, time)
        return found.select(*[column(c) for c in points.columns], *[F.col("_hit")[c].alias(c) for c in take])
    if blocks is None:
        ends = intervals.select(F.explode(F.array(column(start), column(end))).alias("_time"))
        blocks = plan_blocks(points.select(column(time).alias("_time")).unionByName(ends), "_time")
    steps = winning_steps(intervals, keys, start, end, priority, take, pick, blocks)
    hit = F.struct(*[column(c) for c in take]).alias("_hit")
    both = interleave(points, steps, keys, time, "_time", [hit], 1, F.col("_side"))
    walked = running(both, keys, ["_time", "_side"], F.col("_hit"), "last", "_hit", blocks)
    return walked.where("_left").select(
        *[column(c) for c in points.columns], *[F.col("_hit")[c].alias(c) for c in take]
    )


def multiclass_label(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str,
    name: str = "multiclass_label", blocks: Blocks | None = None, index: bool | None = None,
) -> DataFrame:
    """Number k of the first interval ``(k, start, end)`` holding the time, 0 if none.

    Intervals of an entity follow each other in the order of k and may share a bound, which then
    belongs to the earlier one. So one as-of pass is enough; :func:`lookup_interval` takes
    intervals that overlap.
    """
    def previous(window: W) -> dict[str, Column]:
        return {"_previous": F.when(F.lag("k").over(window) == column("k") - 1, F.lag("end").over(window))}

    if index is None:
        index = blocks is None and fits(intervals, [*keys, "k", "start", "end"])
    if index:
        joined = intervals.withColumns(previous(W.partitionBy(*map(column, keys)).orderBy("k")))
    else:
        joined = over_neighbours(intervals, keys, ["k"], 1, 0, previous)
    shared = F.coalesce(F.col("_previous") == column("start"), F.lit(False))
    hit = F.struct(column("k").cast("int").alias("k"), column("end").alias("end")).alias("_hit")
    if index:
        steps = joined.select(*map(column, keys), column("start").alias("_time"), F.when(shared, 2).otherwise(0).alias("_side"), hit)
        found = look_up(points, steps, keys, time)
        label = F.coalesce(F.when(column(time) <= F.col("_hit.end"), F.col("_hit.k")), F.lit(0))
        return found.select(*map(column, points.columns), label.alias(name))
    both = interleave(points, joined, keys, time, "start", [hit], 1, F.when(shared, 2).otherwise(0))
    if blocks is None:
        blocks = plan_times(points, intervals, time, "start")
    walked = running(both, keys, ["_time", "_side"], F.col("_hit"), "last", "_hit", blocks)
    label = F.when(F.col("_time") <= F.col("_hit.end"), F.col("_hit.k")).otherwise(0)
    return walked.where("_left").select(*map(column, points.columns), label.alias(name))


def attach_captions(
    frames: DataFrame, captions: DataFrame, keys: Sequence[str], size: int, frame: str = "frame",
    fps: float = 30.0, vector: str = "embedding", order: str = "seq", **options,
) -> DataFrame:
    """Each frame with the vector of the last caption spoken at that time, zeros if none."""
    timed = frames.withColumn("_at", column(frame) / F.lit(fps))
    found = lookup_interval(timed, captions, keys, "_at", "start_time", "end_time", order, [vector], "last", **options)
    silent = F.array_repeat(F.lit(0.0).cast("float"), size)
    return found.withColumn(vector, F.coalesce(column(vector), silent)).drop("_at")


def next_window(
    points: DataFrame, windows: DataFrame, keys: Sequence[str], time: str, window_id: str = "window_id",
    end_time: str = "end_time", legacy: bool = False, **options,
) -> DataFrame:
    """Each point with the first window ending after it; past the last one null.

    ``legacy`` gives the entity's first window there instead of null.
    """
    found = asof_join(points, windows, keys, time, end_time, [window_id], "forward", True, window_id, **options)
    if not legacy:
        return found
    first = windows.groupBy(*map(column, keys)).agg(
        F.min_by(column(window_id), F.struct(column(end_time), column(window_id))).alias("_first")
    )
    return (
        found.join(first, list(keys), "left")
        .withColumn(window_id, F.coalesce(column(window_id), F.col("_first")))
        .drop("_first")
    )


def regular_window(time: Column, duration: float, hop: float, windows: Column | None = None) -> Column:
    """Closed form of :func:`next_window` for windows ``[k·hop, k·hop + duration]``."""
    k = F.greatest(F.floor((time - F.lit(duration)) / F.lit(hop)) + 1, F.lit(0)).cast("long")
    return k if windows is None else F.when(k < windows, k)


def window_first_label(
    windows: DataFrame, labels: DataFrame, keys: Sequence[str], time: str, label: str,
    start: str = "start_time", end: str = "end_time", **options,
) -> DataFrame:
    """Each window with the first label row in ``[start, end)``, null if it holds none."""
    taken = labels.select(*map(column, keys), column(time).alias("_label_time"), column(label))
    found = asof_join(
        windows, taken, keys, start, "_label_time", ["_label_time", label], "forward", tiebreak=label, **options
    )
    return found.withColumn(label, F.when(F.col("_label_time") < column(end), column(label))).drop("_label_time")


def window_mode_label(
    labels: DataFrame, keys: Sequence[str], time: str, label: str, duration: float, hop: float
) -> DataFrame:
    """Most common label per regular window ``[k·hop, k·hop + duration)``; ties go to the smallest."""
    first = F.greatest(F.floor((column(time) - duration) / hop) + 1, F.lit(0)).cast("long")
    last = F.floor(column(time) / hop).cast("long")
    counts = (
        labels.where(last >= first)
        .select(*map(column, keys), F.explode(F.sequence(first, last)).alias("window_id"), column(label))
        .groupBy(*map(column, keys), "window_id", column(label))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counts.groupBy(*map(column, keys), "window_id").agg(
        F.min_by(column(label), F.struct(-F.col("_n"), column(label))).alias(label)
    )
