"""Counts, shares, cross-tabs and distribution summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessiongrid.operators import aggregate
from sessiongrid.operators.align import keep_entities
from sessiongrid.queries.base import SESSIONS_SQL, load, query, sessions

KINDS = ["click", "view", "purchase", "signup", "error"]


@query("""
WITH c AS (SELECT user_id, list_position(['click', 'view', 'purchase', 'signup', 'error'], event_type) - 1 AS y FROM events)
SELECT user_id, count(*)::BIGINT AS total,
  count_if(y = 0)::BIGINT AS n_0, count_if(y = 1)::BIGINT AS n_1, count_if(y = 2)::BIGINT AS n_2, count_if(y = 3)::BIGINT AS n_3,
  count_if(y = 4)::BIGINT AS n_4, round(count_if(y = 4) * 100.0::DOUBLE / count(*), 1) AS pct_4,
  round(count_if(y = 0) * 100.0::DOUBLE / count(*), 1) AS pct_0, round(count_if(y = 1) * 100.0::DOUBLE / count(*), 1) AS pct_1,
  round(count_if(y = 2) * 100.0::DOUBLE / count(*), 1) AS pct_2, round(count_if(y = 3) * 100.0::DOUBLE / count(*), 1) AS pct_3
FROM c GROUP BY user_id""")
def multiclass_share_by_user(spark, sf_dir):
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")) - 1
    events = load(spark, sf_dir, "events").select("user_id", place.alias("y"))
    return aggregate.label_shares(events, ["user_id"], "y", [0, 1, 2, 3, 4])


CONFIDENCES = [f"c_{i}" for i in range(64)]


def _confidences(spark, sf_dir):
    parts = [F.get("embedding", i).cast("double").alias(c) for i, c in enumerate(CONFIDENCES)]
    return load(spark, sf_dir, "embeddings").select("label", *parts)


CONFIDENCES_SQL = """kp AS (SELECT label, 'c_' || i AS keypoint, embedding[i + 1]::DOUBLE AS v
  FROM embeddings, range(64) AS r(i)),
pk AS (SELECT label, keypoint, count_if(v > 0)::BIGINT AS n_positive, coalesce(avg(v) FILTER (WHERE v > 0), 0) AS mean_positive
  FROM kp GROUP BY label, keypoint)"""


@query(f"""WITH {CONFIDENCES_SQL} SELECT label, keypoint, n_positive, round(mean_positive, 9) AS mean_positive FROM pk""")
def positive_mean(spark, sf_dir):
    found = aggregate.positive_confidence(_confidences(spark, sf_dir), ["label"], CONFIDENCES)
    return found.withColumn("mean_positive", F.round("mean_positive", 9))


@query(f"""WITH {CONFIDENCES_SQL}, lo AS (SELECT label, 100.0::DOUBLE * count_if(v > 0 AND v < 0.05) / count_if(v > 0) AS pct_low FROM kp GROUP BY label)
SELECT pk.label, round(avg(mean_positive), 9) AS compound, round(max(lo.pct_low), 6) AS pct_low
FROM pk JOIN lo ON lo.label = pk.label GROUP BY pk.label""")
def positive_mean_share(spark, sf_dir):
    """Compound confidence per entity and the share of low confidences."""
    table = _confidences(spark, sf_dir)
    compound = aggregate.compound_confidence(aggregate.positive_confidence(table, ["label"], CONFIDENCES), ["label"])
    low = aggregate.low_confidence_percent(table, ["label"], CONFIDENCES, 0.05)
    return compound.join(low, "label").select("label", F.round("compound", 9).alias("compound"), F.round("pct_low", 6).alias("pct_low"))


@query(f"""WITH {CONFIDENCES_SQL}, ok AS (SELECT label FROM pk GROUP BY label HAVING avg(mean_positive) >= 0.1)
SELECT vec_id, label FROM embeddings WHERE label IN (SELECT label FROM ok)""")
def entity_exclusion(spark, sf_dir):
    per_keypoint = aggregate.positive_confidence(_confidences(spark, sf_dir), ["label"], CONFIDENCES)
    kept = aggregate.reliable_entities(aggregate.compound_confidence(per_keypoint, ["label"]), 0.1)
    return keep_entities(load(spark, sf_dir, "embeddings").select("vec_id", "label"), kept, ["label"])


@query("""SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY lang, source ORDER BY n DESC""")
def value_counts(spark, sf_dir):
    return aggregate.value_counts(load(spark, sf_dir, "documents"), "lang", "source").orderBy(F.desc("n"))


@query("""SELECT count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT event_type)::BIGINT AS kinds FROM events""")
def distinct_counts(spark, sf_dir):
    return load(spark, sf_dir, "events").agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds")
    )


BANDS_SQL = "bd AS (SELECT floor(value / 50)::INTEGER AS band, event_type FROM events)"


def _bands(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.floor(F.col("value") / 50).cast("int").alias("band"), "event_type")


CELLS = ["error", "refund", "view"]


@query(f"""WITH {BANDS_SQL}, rows AS (SELECT unnest([0, 1, 2, 99])::INTEGER AS band)
SELECT r.band, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'refund') AS refund,
  count(*) FILTER (event_type = 'view') AS "view" FROM rows r LEFT JOIN bd ON bd.band = r.band GROUP BY r.band""")
def crosstab(spark, sf_dir):
    return aggregate.crosstab(_bands(spark, sf_dir), "band", "event_type", [0, 1, 2, 99], CELLS)


@query(f"""WITH {BANDS_SQL}, rows AS (SELECT unnest([0, 1, 2, 99])::INTEGER AS band),
c AS (SELECT r.band, count_if(event_type = 'error') AS a, count_if(event_type = 'refund') AS b, count_if(event_type = 'view') AS c
  FROM rows r LEFT JOIN bd ON bd.band = r.band GROUP BY r.band)
SELECT band, CASE WHEN a + b + c > 0 THEN round(a * 100.0::DOUBLE / (a + b + c), 6) END AS error,
  CASE WHEN a + b + c > 0 THEN round(b * 100.0::DOUBLE / (a + b + c), 6) END AS refund,
  CASE WHEN a + b + c > 0 THEN round(c * 100.0::DOUBLE / (a + b + c), 6) END AS "view" FROM c""")
def crosstab_pct(spark, sf_dir):
    table = aggregate.crosstab(_bands(spark, sf_dir), "band", "event_type", [0, 1, 2, 99], CELLS, percent=True)
    return table.select("band", *[F.round(c, 6).alias(c) for c in CELLS])


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, min(n)::BIGINT AS n_min FROM c GROUP BY user_id""")
def min_class_count(spark, sf_dir):
    return aggregate.smallest_class_size(load(spark, sf_dir, "events"), "event_type", ["user_id"])


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c)
SELECT user_id, event_type AS majority, n FROM r WHERE rn = 1""")
def majority_class(spark, sf_dir):
    return aggregate.majority_class(load(spark, sf_dir, "events"), "event_type", ["user_id"])


def _curve(spark, sf_dir):
    """Metric rows by fold and epoch."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_linenumber").alias("fold"), F.col("l_quantity").cast("int").alias("epoch"), F.col("l_returnflag").alias("metric")
    ).agg(F.avg("l_tax").alias("value"))


CURVE_SQL = """cu AS (SELECT l_linenumber AS fold, l_quantity::INTEGER AS epoch, l_returnflag AS metric, avg(l_tax) AS value
  FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {CURVE_SQL} SELECT fold, epoch, metric, round(value, 9) AS value FROM cu""")
def learning_curve(spark, sf_dir):
    return _curve(spark, sf_dir).withColumn("value", F.round("value", 9))


@query(f"""WITH {CURVE_SQL} SELECT epoch, metric, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS sd FROM cu GROUP BY epoch, metric""")
def fold_mean_std(spark, sf_dir):
    summary = aggregate.fold_summary(_curve(spark, sf_dir), ["epoch", "metric"])
    return summary.select("epoch", "metric", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query(f"""WITH {CURVE_SQL}, m AS (SELECT metric, epoch, avg(value) AS mean FROM cu WHERE epoch >= 30 GROUP BY metric, epoch)
SELECT metric, max_by(epoch, mean) AS best_epoch, round(max(mean), 9) AS best_mean FROM m GROUP BY metric""")
def best_epoch(spark, sf_dir):
    found = aggregate.best_epoch(_curve(spark, sf_dir), ["metric"])
    return found.select("metric", "best_epoch", F.round("best_mean", 9).alias("best_mean"))


def _file_metrics(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.col("source").alias("file"), F.col("lang").alias("metric")).agg(
        F.avg("n_chars").alias("value")
    )


FILE_METRICS_SQL = "fm AS (SELECT source AS file, lang AS metric, avg(n_chars) AS value FROM documents GROUP BY ALL)"


@query(f"""WITH {FILE_METRICS_SQL} SELECT metric, round(avg(value), 6) AS average FROM fm GROUP BY metric""")
def file_average(spark, sf_dir):
    return aggregate.file_average(_file_metrics(spark, sf_dir), "file", "metric", "value").withColumn("average", F.round("average", 6))


@query(f"""WITH {FILE_METRICS_SQL} SELECT metric, round(sum(value) / (SELECT count(DISTINCT file) FROM fm), 6) AS average FROM fm GROUP BY metric""")
def file_average_per_file(spark, sf_dir):
    found = aggregate.file_average(_file_metrics(spark, sf_dir), "file", "metric", "value", "per_file")
    return found.withColumn("average", F.round("average", 6))


@query(f"""
WITH {SESSIONS_SQL}, s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*)::DOUBLE, -0.2) AS h FROM ev GROUP BY event_type),
w AS (SELECT event_type, value AS v, count(*) AS w FROM ev GROUP BY ALL),
g AS (SELECT unnest(range(40))::INTEGER AS point)
SELECT w.event_type, g.point, round(sum(w.w * exp(-pow((g.point * (200.0::DOUBLE / 39) - w.v) / s.h, 2) / 2)
    / (s.n * s.h * sqrt(2 * pi()))), 9) AS density, round(g.point * (200.0::DOUBLE / 39), 9) AS x
FROM w JOIN s ON s.event_type = w.event_type CROSS JOIN g GROUP BY w.event_type, g.point""")
def kde_grid(spark, sf_dir):
    found = aggregate.kde_grid(sessions(spark, sf_dir), "event_type", "value", 0.0, 200.0, 40)
    return found.withColumns({"density": F.round("density", 9), "x": F.round("x", 9)})


@query("""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY event_type)
SELECT e.event_type, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3, min(value) AS whisker_low, max(value) AS whisker_high
FROM events e JOIN q ON q.event_type = e.event_type
WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def boxplot_stats(spark, sf_dir):
    found = aggregate.box_stats(load(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")
    return found.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag""")
def bar_stats(spark, sf_dir):
    bars = aggregate.class_bars(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    return bars.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("""
WITH f AS (SELECT DISTINCT p_name AS name FROM part)
SELECT CASE WHEN regexp_matches(name, '^small') THEN 'small' WHEN regexp_matches(name, 'ring$') THEN 'ring' ELSE 'other' END AS family,
  count(*)::BIGINT AS n FROM f GROUP BY family""")
def feature_families(spark, sf_dir):
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return aggregate.feature_family_counts(names, "name", {"small": "^small", "ring": "ring$"})


@query("""
WITH l AS (SELECT l_returnflag AS g, 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem),
m AS (SELECT g, feature, avg(v) AS m FROM l GROUP BY ALL)
SELECT l.g AS l_returnflag, l.feature, count(*)::BIGINT AS n,
  round(avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5), 6) AS skewness, round(avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3, 6) AS kurtosis
FROM l JOIN m ON m.g = l.g AND m.feature = l.feature GROUP BY l.g, l.feature""")
def group_moments(spark, sf_dir):
    found = aggregate.group_moments(load(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"])
    return found.withColumns({"skewness": F.round("skewness", 6), "kurtosis": F.round("kurtosis", 6)})


@query(f"""WITH {SESSIONS_SQL} SELECT user_id, min(t) AS start FROM ev GROUP BY user_id""")
def interaction_start(spark, sf_dir):
    return aggregate.interaction_start(sessions(spark, sf_dir), ["user_id"], "t")
