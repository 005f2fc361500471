"""Metric texts: ``name: value`` lines, one file or folder per fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.functions.text import metric_name, metric_value
from sessiongrid.operators.ordered import column


def parse_metric_lines(lines: DataFrame, line: str = "value", keep: Sequence[str] = ("file",)) -> DataFrame:
    """Lines to ``keep…, metric, value``; other lines drop out."""
    parsed = lines.select(
        *map(column, keep), metric_name(column(line)).alias("metric"), metric_value(column(line)).alias("value")
    )
    return parsed.where(F.col("metric").isNotNull())


def read_metric_files(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.options(pathGlobFilter="*.txt", recursiveFileLookup=True).text(path)
    return parse_metric_lines(lines.select(F.col("_metadata.file_path").alias("file"), "value"))


def write_metric_files(metrics: DataFrame, path: str, by: Sequence[str] = ("fold",), mode: str = "append") -> None:
    """Long metrics to text, a folder per fold."""
    line = F.concat_ws(": ", "metric", F.col("value").cast("string")).alias("value")
    metrics.select(*map(column, by), line).write.partitionBy(*by).mode(mode).text(path)
