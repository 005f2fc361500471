"""Sinks, vector stores, media listings, and what is left to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.functions.text import file_stem
from sessiongrid.operators.align import missing_keys
from sessiongrid.operators.ordered import column


def write_frames(
    df: DataFrame, path: str, by: Sequence[str] = (), file_format: str = "parquet", mode: str = "error",
    rows_per_file: int = 5_000_000,
) -> None:
    """Write a table, in folders per ``by``.

    Rows are not gathered per folder, so a huge entity is written by many tasks in files of
    bounded length.
    """
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if by:
        writer = writer.partitionBy(*by)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)


def write_vectors(df: DataFrame, path: str, keys: Sequence[str], vector: str, mode: str = "error") -> None:
    df.select(*map(column, keys), column(vector).cast("array<float>").alias(vector)).write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str, wanted: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The stored vectors, or those of the ``wanted`` keys."""
    stored = spark.read.parquet(path)
    return stored if wanted is None else wanted.join(stored, list(keys), "left")


#: the folder of rows without a key
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def write_documents(df: DataFrame, path: str, by: Sequence[str], document: str, name: str = "part.json", mode: str = "error") -> None:
    """A table of (path, content), one row a document: its path in folders per ``by``, as if it were a file there, and its text.

    For millions of small documents, where a file each costs far more than its content. A path has one document; of several the least stays.
    """
    folders = [
        F.concat(F.lit(f"{k}="), F.coalesce(F.replace(F.url_encode(F.nullif(column(k).cast("string"), F.lit(""))), F.lit("+"), F.lit("%20")), F.lit(NO_KEY))) for k in by
    ]
    named = df.select(F.concat_ws("/", *folders, F.lit(name)).alias("path"), column(document).cast("string").alias("content"))
    named.groupBy("path").agg(F.min("content").alias("content")).write.mode(mode).parquet(path)


BUCKETS = "buckets_of_"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*map(column, keys)), F.lit(buckets)).cast("int")


def write_vectors_by_key(
    df: DataFrame, path: str, keys: Sequence[str], vector: str, buckets: int = 256, mode: str = "error", rows_per_file: int = 1_000_000
) -> None:
    """Vectors in folders by a hash of their keys, so that a lookup opens the folders of its keys alone.

    Rows are dealt by ranges of (folder, keys), not by folder, so a task's share does not depend on how even the folders are;
    a file is sorted by its keys. Choose ``buckets`` so that a folder has a few files; the reader sees the number in the folders' names.
    """
    place = f"{BUCKETS}{buckets}"
    rows = df.select(*map(column, keys), column(vector).cast("array<float>").alias(vector)).withColumn(place, _bucket(keys, buckets))
    order = [place, *keys]
    dealt = rows.repartitionByRange(*map(column, order)).sortWithinPartitions(*map(column, order))
    dealt.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(place).parquet(path)


def lookup_vectors(wanted: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` with the vectors of their keys, null where there is none; other folders are not read.

    Only the numbers of the folders reach the driver, which are at most as many as there are folders. The keys are
    brought to the types they are stored in; a column of ``wanted`` named as the vector is replaced.
    """
    stored = wanted.sparkSession.read.parquet(path)
    place = next(c for c in stored.columns if c.startswith(BUCKETS))
    typed = wanted.withColumns({k: column(k).cast(stored.schema[k].dataType) for k in keys})
    folders = typed.select(_bucket(keys, int(place.removeprefix(BUCKETS))).alias("n")).distinct().collect()
    rows = stored.where(column(place).isin([r["n"] for r in folders])).drop(place)
    return typed.drop(*set(rows.columns).difference(keys)).join(rows, list(keys), "left")


def list_media(spark: SparkSession, path: str, suffix: str = "wav", stem_pattern: str | None = None) -> DataFrame:
    """File, stem, length and time of media files; contents are not read.

    The stem is the file's name without its ending, or the first group of ``stem_pattern`` in its path.
    """
    files = spark.read.format("binaryFile").options(pathGlobFilter=f"*.{suffix}", recursiveFileLookup=True).load(path)
    return files.select(
        F.col("path").alias("file"), (F.regexp_extract("path", stem_pattern, 1) if stem_pattern else file_stem(F.col("path"))).alias("stem"),
        "length", "modificationTime",
    )


def unmatched_media(media: DataFrame, table: DataFrame, stem: str = "stem") -> DataFrame:
    """Media without a row of the same stem in ``table``."""
    return missing_keys(media, table, [stem])


def pending(source: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose output is not there yet."""
    return missing_keys(source, done, keys)
