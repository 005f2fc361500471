"""What the registered queries share: the registry, table loading and the session view of events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.functions.clock import micros_of
from sessiongrid.operators.ordered import row_index

Query = Callable[[SparkSession, str], DataFrame]
START_MICROS = 1_704_067_200_000_000
HOUR = 3_600_000_000
DAY = 24 * HOUR
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; without SQL it is checked by tests alone."""

    def add(run: Query) -> Query:
        REGISTRY[run.__name__] = Registered(run, sql)
        return run

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as session rows: entity ``user_id``, micros ``us``, seconds ``t`` and number ``k``."""
    us = micros_of(F.col("ts"))
    return load(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", "value", us.alias("us"),
        ((us - START_MICROS) / F.lit(1_000_000.0)).alias("t"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session rows with a frame number per user in time order, from 0."""
    return row_index(sessions(spark, sf_dir), ["user_id"], ["us", "event_id"], "frame")


SESSIONS_SQL = f"""ev AS (
  SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us,
         (epoch_us(ts) - {START_MICROS}) / 1000000.0::DOUBLE AS t,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k
  FROM events)"""
FRAMES_SQL = f"""{SESSIONS_SQL}, fr AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS frame FROM ev)"""
