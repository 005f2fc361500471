"""Summaries and fits that stay small at any number of rows: merged sketches, one Gram matrix for all subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sessiongrid.operators import sketches
from sessiongrid.plans import modalities
from sessiongrid.queries.base import load, query, sessions
from sessiongrid.queries.preparation import KEYS
from sessiongrid.session import new_path, settle

SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("""SELECT event_type, unnest(['value', 'k']) AS feature, unnest([count(value), count(k)]) AS n, round(unnest([min(value), min(k)]), 6) AS low,
  round(unnest([max(value), max(k)]), 6) AS high, true AS daily_within, true AS whole_within
FROM (SELECT event_type, value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events) GROUP BY event_type""")
def sketched_quantiles(spark, sf_dir):
    """Quantiles of sketches merged over days, and of sketches of all rows, hold their bound of the rank error."""
    rows = sessions(spark, sf_dir).select("event_type", F.floor(F.col("t") / F.lit(86400.0)).alias("day"), "value", "k")
    daily = settle(sketches.value_sketches(rows, ["event_type", "day"], ["value", "k"]))
    merged = settle(sketches.merged_sketches(daily, ["event_type"]))

    def held(found, name):
        errors = sketches.rank_errors(rows, found, ["event_type"], ["value", "k"], SHARES)
        return errors.groupBy("event_type", "feature").agg((F.max("error") <= sketches.ERROR).alias(name))

    whole = settle(sketches.value_sketches(rows, ["event_type"], ["value", "k"]))
    ends = merged.select("event_type", "feature", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
    return ends.join(held(merged, "daily_within"), ["event_type", "feature"]).join(held(whole, "whole_within"), ["event_type", "feature"])


@query(f"""
WITH b AS (SELECT event_type, quantile_disc(value, {0.25 - sketches.ERROR}::DOUBLE) AS a1, quantile_disc(value, {0.25 + sketches.ERROR}::DOUBLE) AS a2,
  quantile_disc(value, {0.5 - sketches.ERROR}::DOUBLE) AS b1, quantile_disc(value, {0.5 + sketches.ERROR}::DOUBLE) AS b2,
  quantile_disc(value, {0.75 - sketches.ERROR}::DOUBLE) AS c1, quantile_disc(value, {0.75 + sketches.ERROR}::DOUBLE) AS c2 FROM events GROUP BY event_type)
SELECT event_type, a1 <= a2 AS q1_within, b1 <= b2 AS median_within, c1 <= c2 AS q3_within, true AS whiskers_within FROM b""")
def sketched_box_stats(spark, sf_dir):
    """Box statistics from sketches: quartiles between the exact ones a percent to either side, whiskers inside their fences."""
    events = load(spark, sf_dir, "events").select("event_type", "value")
    made = sketches.sketched_box_stats(events, settle(sketches.value_sketches(events, ["event_type"], ["value"])), ["event_type"], "value")
    exact = events.groupBy("event_type").agg(*[
        F.percentile("value", F.array(*[F.lit(max(0.0, s - 1.5 * sketches.ERROR)), F.lit(min(1.0, s + 1.5 * sketches.ERROR))])).alias(f"_{n}")
        for n, s in zip(("q1", "median", "q3"), sketches.QUARTILES)
    ])
    fence = (F.col("q3") - F.col("q1")) * 1.5
    whiskers = (F.col("whisker_low") >= F.col("q1") - fence) & (F.col("whisker_high") <= F.col("q3") + fence) & (F.col("whisker_low") <= F.col("whisker_high"))
    return made.join(exact, "event_type").select(
        "event_type", *[F.col(n).between(F.get(f"_{n}", 0), F.get(f"_{n}", 1)).alias(f"{n}_within") for n in ("q1", "median", "q3")],
        whiskers.alias("whiskers_within"),
    )


TABLE_GROUPS = {"pose": ["l_quantity", "l_extendedprice"], "audio": ["l_tax"], "facial": ["l_discount"]}
COMBINATIONS = {"pose": ["l_quantity", "l_extendedprice"], "audio": ["l_tax"], "facial": ["l_discount"], "audio_facial": ["l_tax", "l_discount"]}


def _tables_sql() -> str:
    parts = []
    for name, features in COMBINATIONS.items():
        for feature in features:
            for flavour, size in (("clean", f"sqrt(avg({feature} * {feature}))"), ("norm", "1.0::DOUBLE")):
                parts.append(f"SELECT '{name}' AS combination, '{flavour}' AS flavour, '{feature}' AS feature, count(*) AS n, round({size}, 4) AS size FROM lineitem")
        r = f"abs(corr({features[0]}, {features[-1]}))"
        for i, spread in enumerate([f"sqrt(1 + {r})", f"sqrt(1 - {r})"] if len(features) == 2 else ["1.0::DOUBLE"]):
            parts.append(f"SELECT '{name}', 'pca', 'pc{i + 1}', count(*), round({spread}, 4) FROM lineitem")
    return " UNION ALL ".join(parts)


@query(_tables_sql())
def modality_tables(spark, sf_dir):
    """Four modality subsets in three flavours, fitted by one scan, written in folders and read again: rows and root mean squares."""
    lines = load(spark, sf_dir, "lineitem").select(*KEYS, "l_quantity", "l_extendedprice", "l_tax", "l_discount")
    tables = modalities.modality_tables(lines, list(COMBINATIONS), variance=0.999, groups=TABLE_GROUPS, keys=KEYS)
    path = new_path(spark)
    modalities.write_modality_tables(tables, path)
    parts = []
    for combination, flavour in tables:
        df = spark.read.parquet(f"{path}/combination={combination}/flavour={flavour}")
        sizes = [F.struct(F.lit(f).alias("feature"), F.count(f).alias("n"), F.round(F.sqrt(F.avg(F.col(f) * F.col(f))), 4).alias("size")) for f in df.columns if f not in KEYS]
        parts.append(df.agg(F.array(*sizes).alias("_s")).select(F.lit(combination).alias("combination"), F.lit(flavour).alias("flavour"), F.inline("_s")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("""
WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS sa, avg(l_tax) AS b, stddev_pop(l_tax) AS sb, sign(corr(l_quantity, l_tax)) AS r FROM lineitem),
z AS (SELECT l_orderkey, l_linenumber, (l_quantity - a) / sa AS x, r * (l_tax - b) / sb AS y FROM lineitem, m)
SELECT l_orderkey, l_linenumber, round((x + y) / sqrt(2.0::DOUBLE), 6) AS pc1, round((x - y) / sqrt(2.0::DOUBLE), 6) AS pc2 FROM z""")
def pca_two(spark, sf_dir):
    """Both components of two standardised features: their sum and difference."""
    lines = load(spark, sf_dir, "lineitem").select(*KEYS, "l_quantity", "l_tax")
    gram = modalities.Gram.fit(lines, ["l_quantity", "l_tax"])
    made = gram.components(["l_quantity", "l_tax"], 0.999).transform(lines)
    return made.withColumns({c: F.round(c, 6) for c in ("pc1", "pc2")})
