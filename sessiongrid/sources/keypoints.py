"""Body keypoint documents: one JSON file per frame, flattened to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.catalog import BODY_JOINTS, UPPER_JOINTS
from sessiongrid.functions.text import frame_of_name
from sessiongrid.operators.ordered import column
from sessiongrid.sources.store import NO_KEY

DOCUMENT = "people ARRAY<STRUCT<pose_keypoints_2d: ARRAY<DOUBLE>>>"


def _folder(path: Column, key: str) -> Column:
    """The value of the folder ``key=…`` in a path, null for the folder of nulls."""
    value = F.regexp_extract(path, f"(?:^|/){key}=([^/]*)/", 1)
    return F.when(~value.isin("", NO_KEY), F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))))


def read_keypoints(
    spark: SparkSession, paths: str | Sequence[str], entity_pattern: str = r"^([^_]+)", broken: str = "null", packed: bool = False
) -> DataFrame:
    """Rows ``participant, frame, keypoints``, one a document; a frame without people has null keypoints.

    Keys are those of folders ``participant=…/frame=…`` if there are any, else parts of the file name. A document
    that cannot be read has null keypoints too, or is left out (``broken="drop"``), or ends the work (``"fail"``). Small files
    are packed into tasks by the reader; above some ten thousand frames, opening a file for each takes far longer than reading it, so
    ``packed`` reads tables of (path, content), as :func:`~sessiongrid.sources.store.write_documents` or a copy of Spark's
    ``binaryFile`` makes them.
    """
    if broken not in ("null", "drop", "fail"):
        raise ValueError(f"broken must be null, drop or fail, not {broken}")
    mode = {"null": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}[broken]
    if packed:
        return _read_packed(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)), entity_pattern, broken)
    read = spark.read.schema(DOCUMENT).options(multiLine=True, mode=mode).json(paths)
    foldered = {"participant", "frame"} <= set(read.columns)
    if foldered:
        read = spark.read.schema(f"{DOCUMENT}, participant STRING, frame INT").options(multiLine=True, mode=mode).json(paths)
    name = F.col("_metadata.file_name")
    return read.select(
        (column("participant") if foldered else F.regexp_extract(name, entity_pattern, 1)).alias("participant"),
        (column("frame") if foldered else frame_of_name(name)).alias("frame"),
        F.get(F.col("people"), 0)["pose_keypoints_2d"].alias("keypoints"),
    )


def _read_packed(documents: DataFrame, entity_pattern: str, broken: str) -> DataFrame:
    """The rows of documents that lie in a table with the paths they have as files."""
    path, name = F.col("path"), F.element_at(F.split("path", "/"), -1)
    foldered = path.rlike("(^|/)participant=[^/]*/") & path.rlike("(^|/)frame=[^/]*/")
    options = {"mode": "FAILFAST"} if broken == "fail" else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = F.from_json(F.col("content").cast("string"), DOCUMENT if broken == "fail" else f"{DOCUMENT}, _broken STRING", options)
    read = documents.select("path", parsed.alias("_document"))
    if broken == "drop":
        read = read.where(F.col("_document._broken").isNull())
    return read.select(
        F.when(foldered, _folder(path, "participant")).otherwise(F.regexp_extract(name, entity_pattern, 1)).alias("participant"),
        F.when(foldered, _folder(path, "frame").cast("int")).otherwise(frame_of_name(name)).alias("frame"),
        F.get(F.col("_document.people"), 0)["pose_keypoints_2d"].alias("keypoints"),
    )


def keypoint_columns(keypoints: Column, joints: Sequence[str], order: Sequence[str] = BODY_JOINTS) -> list[Column]:
    """``<joint>_x, _y, _c`` for each joint, from the flat array in the body model's order."""
    return [
        F.get(keypoints, 3 * order.index(joint) + place).alias(f"{joint}_{axis}")
        for joint in joints
        for place, axis in enumerate("xyc")
    ]


def flatten_keypoints(
    df: DataFrame, keypoints: str = "keypoints", joints: Sequence[str] = BODY_JOINTS,
    order: Sequence[str] = BODY_JOINTS,
) -> DataFrame:
    rest = [column(c) for c in df.columns if c != keypoints]
    return df.select(*rest, *keypoint_columns(column(keypoints), joints, order))


def upper_body(df: DataFrame, keypoints: str = "keypoints") -> DataFrame:
    return flatten_keypoints(df, keypoints, UPPER_JOINTS)
