"""CSV tables with declared schemas, one file or a directory with one file per entity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.functions.text import file_stem
from sessiongrid.operators.clean import trimmed_names
from sessiongrid.operators.ordered import column

INT, DOUBLE, STRING = T.IntegerType(), T.DoubleType(), T.StringType()


def declared(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


TURNS = declared(speaker=STRING, start=DOUBLE, end=DOUBLE, duration=DOUBLE)
ALL_TURNS = declared(participant_num=STRING, speaker=STRING, start=DOUBLE, end=DOUBLE, duration=DOUBLE)
ERRORS = declared(participant_num=INT, start=DOUBLE, end=DOUBLE, error=INT)
ANNOTATIONS = declared(
    video_id=INT, annotation_id=INT, participant_num=INT, start=DOUBLE, end=DOUBLE, labels=STRING, error=INT
)
INTERACTIONS = declared(participant_num=INT, start=DOUBLE, end=DOUBLE)
IMPORTANCES = declared(feature=STRING, importance=DOUBLE)
P_VALUES = declared(feature=STRING, p_value=DOUBLE)


def files_by_header(spark: SparkSession, paths: str | Sequence[str]) -> list[list[str]]:
    """The files of ``paths`` in groups with the same header line; a row per file reaches the driver."""
    lines = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "line").alias("header"))
    groups: dict[str, list[str]] = {}
    for r in first.orderBy("file_path").collect():
        groups.setdefault(r["header"], []).append(unquote(r["file_path"]))
    return list(groups.values())


def _by_name(spark: SparkSession, paths: str | Sequence[str], file: str | None = None, **options) -> DataFrame:
    """Header CSV as text by column name: files with other headers or another order are read apart and united."""
    groups = files_by_header(spark, paths)
    read = spark.read.options(header=True, escape='"', **options)
    parts = [read.csv(g) for g in (groups if len(groups) > 1 else [paths])]
    if file:
        parts = [p.select("*", F.col("_metadata.file_name").alias(file)) for p in parts]
    parts = [trimmed_names(p) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_raw(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """Header CSV with every column as text and names trimmed."""
    return _by_name(spark, paths, **options)


def read_table(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, **options) -> DataFrame:
    """Header CSV by column name: only declared columns, bad values null, absent columns null."""
    raw = read_raw(spark, paths, **options)
    return raw.select(*_declared(raw, schema))


def read_entity_files(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, entity: str = "participant",
    pattern: str = r"^([^_.]+)",
) -> DataFrame:
    """One file per entity, by column name; the entity is a match in the file name."""
    named = _by_name(spark, paths, "_file")
    return named.select(F.regexp_extract("_file", pattern, 1).alias(entity), *_declared(named, schema, skip=(entity,)))


def _declared(raw: DataFrame, schema: T.StructType, skip: Sequence[str] = ()) -> list:
    return [
        (column(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
        if f.name not in skip
    ]


def entity_of_file_column(df: DataFrame, file: str = "file", entity: str = "participant") -> DataFrame:
    return df.withColumn(entity, file_stem(column(file)))


def read_feature_list(spark: SparkSession, path: str, name: str = "feature") -> list[str]:
    """Feature names of a sidecar file; a list as long as the feature table is wide."""
    rows = read_raw(spark, path).select(column(name)).collect()
    return [r[0].strip() for r in rows if r[0]]
