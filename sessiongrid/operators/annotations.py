"""Annotations against error events: label rows, response times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.functions.text import other_bucket, split_labels
from sessiongrid.operators.asof import interleave
from sessiongrid.operators.ordered import Blocks, column, plan_blocks, running
from sessiongrid.operators.rank import first_per_group


def label_rows(
    annotations: DataFrame, labels: str = "labels", vocabulary: Sequence[str] | None = None,
    keep_empty: bool = False, to_other: bool = False,
) -> DataFrame:
    """One row per label of a comma-joined label text.

    Labels outside the vocabulary vanish, or become ``other`` with ``to_other``; rows left without
    a label vanish too unless ``keep_empty``.
    """
    found = split_labels(column(labels), None if to_other else vocabulary)
    if to_other:
        found = other_bucket(found, vocabulary or ())
    explode = F.explode_outer if keep_empty else F.explode
    return annotations.withColumn(labels, explode(found))


def response_times(
    annotations: DataFrame, errors: DataFrame, keys: Sequence[str], order: Sequence[str] = ("start",),
    anchor: str = "start",
) -> DataFrame:
    """Time from the first error row with the same keys to each annotation.

    ``anchor`` names the error time to count from, ``start`` or ``end``.
    """
    first = first_per_group(errors, keys, order).select(*map(column, keys), column(anchor).alias("_anchor"))
    return (
        annotations.join(first, list(keys))
        .withColumn("response_time", column("start") - F.col("_anchor"))
        .drop("_anchor")
    )


def response_summary(
    annotations: DataFrame, errors: DataFrame, entity: str, anchor: str = "end",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Per error row the number of later annotations, their mean and least response time.

    One ordered pass from the end counts and sums the annotations behind each error, so the work
    is linear although the pairs are quadratic. Times are summed as offsets from the least one, whole
    numbers exactly, so epoch times keep their digits. Columns of ``errors`` are kept.
    """
    probes = errors.withColumn("_anchor", column(anchor))
    taken = annotations.select(column(entity), column("start").alias("_at"))
    both = interleave(probes, taken, [entity], "_anchor", "_at", [F.col("_at")], 1, 0)
    whole = isinstance(both.schema["_time"].dataType, T.IntegralType)
    base = both.agg(F.min("_time")).first()[0]
    if blocks is None:
        blocks = plan_blocks(both, ["_time", "_side"])
    order = ["_time", "_side"]
    hit = F.when(~F.col("_left"), F.col("_time"))
    offset = (F.col("_time") - F.lit(base)).cast("decimal(20,0)" if whole else "double")
    counted = running(both, [entity], order, F.when(~F.col("_left"), 1).otherwise(0), "sum", "_later", blocks, True)
    summed = running(counted, [entity], order, F.when(~F.col("_left"), offset).otherwise(0), "sum", "_sum", blocks, True)
    nearest = running(summed, [entity], order, hit, "last", "_next", blocks, True)
    some = F.col("_later") > 0
    behind = (F.col("_sum") - F.col("_later") * offset).cast("double")
    return nearest.where("_left").select(
        *[column(c) for c in errors.columns],
        F.col("_later").cast("long").alias("n_later"),
        F.when(some, behind / F.col("_later")).alias("mean_response"),
        F.when(some, (F.col("_next") - F.col("_anchor")).cast("double")).alias("first_response"),
    )
