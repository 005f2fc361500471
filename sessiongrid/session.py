"""Session settings that the library relies on, and where it may cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter makes the session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("sessiongrid")
    chosen = {**LOCAL_SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **settings}
    for name, value in chosen.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private folder only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="sessiongrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sessiongrid-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    For tables that later steps read many times: the work before is done once, survives lost
    executors, and readers still prune columns and count rows from file footers.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Settled tables of one piece of work, deleted at its end or before by :meth:`drop`.

    What is returned from inside the ``with`` block must not read them: settle it for itself. Deleting goes through
    Spark's file systems, so the folder may be in any store.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for table, _ in list(self.paths.values()):
            self.drop(table)

    def settle(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = table, path
        return table

    def drop(self, table: DataFrame) -> None:
        _, path = self.paths.pop(id(table))
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
