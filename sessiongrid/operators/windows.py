"""Frame deltas, sliding and strided windows, tolerant predictions, hop windows, turn gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongrid.functions.vectors import to_columns
from sessiongrid.operators.ordered import Blocks, column, over_neighbours, row_index


def frame_deltas(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str],
    digits: int = 4, blocks: Blocks | None = None, **options,
) -> DataFrame:
    """``<f>_delta`` behind each feature: change from the previous row, 0.0 in the first."""

    def deltas(window) -> dict[str, Column]:
        return {
            f"{f}_delta": F.coalesce(F.round(column(f) - F.lag(column(f)).over(window), digits), F.lit(0.0))
            for f in features
        }

    added = over_neighbours(df, keys, order, 1, 0, deltas, blocks, **options)
    names = []
    for name in df.columns:
        names += [name, f"{name}_delta"] if name in features else [name]
    return added.select(*[column(n) for n in names])


def sliding_sequences(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int, features: Sequence[str],
    label: str, frame: str | None = None, require_contiguous: bool = False,
    blocks: Blocks | None = None, **options,
) -> DataFrame:
    """One row per window of ``length`` rows, step 1: keys, last order values, ``x``, label.

    ``x`` is an array of rows, each an array of the features. Entities shorter than the window
    give none. Windows go by row adjacency; ``require_contiguous`` asks for unbroken ``frame``.
    """

    def windows(window) -> dict[str, Column]:
        span = window.rowsBetween(-(length - 1), 0)
        found = {"x": F.collect_list(F.array(*[column(f).cast("double") for f in features])).over(span)}
        if require_contiguous:
            found["_first_frame"] = F.first(column(frame)).over(span)
        return found

    made = over_neighbours(df, keys, order, length - 1, 0, windows, blocks, **options)
    made = made.where(F.size("x") == length)
    if require_contiguous:
        made = made.where(column(frame) - F.col("_first_frame") == length - 1)
    return made.select(*map(column, keys), *map(column, order), "x", column(label))


def strided_windows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int, stride: int,
    features: Sequence[str], label: str, context: int = 0, blocks: Blocks | None = None,
) -> DataFrame:
    """Windows starting at rows 0, stride, 2·stride… over ``length + context`` rows.

    The label is that of the last row. Each row goes to the few windows that hold it and a
    window is one group of a fixed number of rows, so long entities spread over all tasks.
    Returns keys, ``window_id``, ``x``, label.
    """
    width = length + context
    indexed = row_index(df, keys, order, "_pos", blocks)
    first = F.greatest(F.floor((F.col("_pos") - width) / F.lit(stride)) + 1, F.lit(0)).cast("long")
    last = F.floor(F.col("_pos") / F.lit(stride)).cast("long")
    row = F.array(*[column(f).cast("double") for f in features])
    return (
        indexed.where(last >= first)
        .select(
            *map(column, keys), "_pos", row.alias("_row"), column(label),
            F.explode(F.sequence(first, last)).alias("window_id"),
        )
        .groupBy(*map(column, keys), "window_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("_pos", "_row"))).alias("_rows"),
            F.max_by(column(label), "_pos").alias(label),
        )
        .where(F.size("_rows") == width)
        .select(*map(column, keys), "window_id", F.col("_rows._row").alias("x"), column(label))
    )


def flat_windows(windows: DataFrame, length: int, features: int, x: str = "x", prefix: str = "f_") -> DataFrame:
    """Window arrays laid out row by row as columns ``f_0…``, for models on flat vectors."""
    rest = [column(c) for c in windows.columns if c != x]
    return windows.select(*rest, *to_columns(F.flatten(column(x)), length * features, prefix))


def window_summaries(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int, features: Sequence[str],
    label: str, blocks: Blocks | None = None, **options,
) -> DataFrame:
    """Mean, sd, min, max, last and slope per feature over each full window of ``length`` rows.

    A flat replacement for sequences where the model only needs summaries.
    """
    indexed = row_index(df, keys, order, "_pos", blocks)

    def summaries(window) -> dict[str, Column]:
        span = window.rowsBetween(-(length - 1), 0)
        found = {"_n": F.count(F.lit(1)).over(span)}
        for f in features:
            x = column(f).cast("double")
            found |= {
                f"{f}_mean": F.avg(x).over(span),
                f"{f}_sd": F.stddev_pop(x).over(span),
                f"{f}_min": F.min(x).over(span),
                f"{f}_max": F.max(x).over(span),
                f"{f}_last": x,
                f"{f}_slope": F.regr_slope(x, F.col("_pos").cast("double")).over(span),
            }
        return found

    made = over_neighbours(
        indexed, keys, order, length - 1, 0, summaries, blocks, index="_pos", **options
    ).where(F.col("_n") == length)
    names = [f"{f}_{s}" for f in features for s in ("mean", "sd", "min", "max", "last", "slope")]
    return made.select(*map(column, keys), *map(column, order), *map(column, names), column(label))


def tolerant_predictions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], truth: str, predicted: str,
    tolerance: int, name: str = "tolerant", blocks: Blocks | None = None, **options,
) -> DataFrame:
    """A prediction equal to some true label within ``tolerance`` rows counts as right.

    It is then replaced by its own row's true label. Neighbours are rows of the same session.
    """

    def near(window) -> dict[str, Column]:
        labels = F.collect_set(column(truth)).over(window.rowsBetween(-tolerance, tolerance))
        hit = F.array_contains(labels, column(predicted))
        return {name: F.when(hit, column(truth)).otherwise(column(predicted))}

    return over_neighbours(df, keys, order, tolerance, tolerance, near, blocks, **options)


def hop_windows(
    df: DataFrame, keys: Sequence[str], time: str, duration: float, hop: float,
    aggregates: Mapping[str, Column],
) -> DataFrame:
    """Aggregates over windows ``[k·hop, k·hop + duration)``, full windows only.

    A window is full if it ends by the entity's last time. Rows are pre-aggregated per window
    before the shuffle.
    """
    at = column(time).cast("double")
    ends = df.groupBy(*map(column, keys)).agg(F.max(at).alias("_end"))
    first = F.greatest(F.floor((at - duration) / hop) + 1, F.lit(0)).cast("long")
    last = F.floor(at / hop).cast("long")
    return (
        df.where(last >= first)
        .withColumn("window_id", F.explode(F.sequence(first, last)))
        .groupBy(*map(column, keys), "window_id")
        .agg(*[c.alias(name) for name, c in aggregates.items()])
        .join(ends, list(keys))
        .where(F.col("window_id") * hop + duration <= F.col("_end"))
        .withColumn("start_time", F.col("window_id") * hop)
        .withColumn("end_time", F.col("window_id") * hop + duration)
        .drop("_end")
    )


def unroll_windows(
    frames: DataFrame, predictions: DataFrame, keys: Sequence[str], index: str, predicted: str,
    length: int, stride: int, window_id: str = "window_id", fill: int = 0,
) -> DataFrame:
    """Window predictions back on frames.

    The first prediction rules ``length - stride`` frames, each later one ``stride`` frames, and
    the rest of the entity is ``fill``. The window of a frame has a closed form, so this is one
    equi-join.
    """
    lead = length - stride
    window = F.when(column(index) < lead, F.lit(0)).otherwise(F.floor((column(index) - lead) / F.lit(stride)) + 1)
    placed = frames.withColumn(window_id, window.cast("long"))
    chosen = predictions.select(*map(column, keys), column(window_id).cast("long").alias(window_id), column(predicted))
    return (
        placed.join(chosen, [*keys, window_id], "left")
        .withColumn(predicted, F.coalesce(column(predicted), F.lit(fill)))
        .drop(window_id)
    )


def turn_gaps(
    turns: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end",
    speaker: str = "speaker", blocks: Blocks | None = None, **options,
) -> DataFrame:
    """Silence between a turn's end and the start of the other speaker's turn right after it, at least 0."""

    def following(window) -> dict[str, Column]:
        return {"_next_speaker": F.lead(column(speaker)).over(window), "_next_start": F.lead(column(start)).over(window)}

    with_next = over_neighbours(turns, keys, [start, end], 0, 1, following, blocks, **options)
    return (
        with_next.where(F.col("_next_speaker") != column(speaker))
        .withColumn("gap", F.greatest(F.col("_next_start") - column(end), F.lit(0.0)))
        .drop("_next_speaker", "_next_start")
    )
