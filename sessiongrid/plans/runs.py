"""A table of experiment runs that can be stopped and taken up again."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: configurations fitted at the same time; Spark shares its cores among their jobs
AT_ONCE = 4
ID = "config_id"


def finished(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The results at ``path``, or None if there are none yet."""
    try:
        read = spark.read if schema is None else spark.read.schema(schema)
        return read.option("basePath", path).parquet(f"{path}/{ID}=*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def left_to_do(configs: DataFrame, path: str) -> DataFrame:
    """Configurations without a result at ``path``."""
    done = finished(configs.sparkSession, path)
    if done is None:
        return configs
    ids = done.select(F.col(ID).cast("string").alias(ID)).distinct()
    return configs.join(ids, configs[ID] == ids[ID], "left_anti")


def run_configs(configs: DataFrame, run: Callable[[Row], DataFrame], path: str, at_once: int = AT_ONCE) -> list[str]:
    """Run every configuration that has no result yet; returns the ids of those run, in order.

    ``configs`` has a text column ``config_id`` and reaches the driver, being as long as the list of experiments.
    ``run(config)`` gives result rows; they are written as the partition ``config_id=…``, which replaces what an earlier
    try left there, and only once they are whole. So a driver lost in between costs the runs under way. An error of one run is
    raised after the others have ended and been written.
    """
    spark = configs.sparkSession
    todo = sorted(left_to_do(configs, path).collect(), key=lambda c: c[ID])

    def one(config: Row) -> Exception | None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"run-{config[ID]}")
        try:
            result = run(config).withColumn(ID, F.lit(config[ID]))
            result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(ID).parquet(path)
        except Exception as error:
            return error
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return None

    with ThreadPoolExecutor(at_once) as pool:
        errors = [e for e in pool.map(one, todo) if e is not None]
    if errors:
        raise errors[0]
    return [c[ID] for c in todo]
