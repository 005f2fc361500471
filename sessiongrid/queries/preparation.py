"""Scaling, components, splits and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessiongrid import catalog
from sessiongrid.operators import sampling, scaling, splits
from sessiongrid.operators import smote as synthetic
from sessiongrid.plans import significance
from sessiongrid.queries.base import MEASURES, SESSIONS_SQL, load, query, sessions

KEYS = ["l_orderkey", "l_linenumber"]


def _scaled_sql(m: str) -> str:
    return f"round(({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER (), 6) AS {m}"


@query(f"""SELECT l_orderkey, l_linenumber, {", ".join(map(_scaled_sql, MEASURES))}, 0.0::DOUBLE AS flat FROM lineitem""")
def standardize(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(*KEYS, *MEASURES, F.lit(7.0).alias("flat"))
    scaled = scaling.standardize(lines, [*MEASURES, "flat"])
    return scaled.withColumns({m: F.round(m, 6) for m in MEASURES})


@query(f"""SELECT l_orderkey, l_linenumber, {_scaled_sql("l_quantity")}, {_scaled_sql("l_tax")} FROM lineitem""")
def modality_norm(spark, sf_dir):
    """Two feature groups, standardised, with the keys once."""
    groups = {"pose": ["l_quantity"], "audio": ["l_tax"], "facial": ["l_discount"]}
    lines = load(spark, sf_dir, "lineitem").select(*KEYS, *MEASURES)
    chosen = catalog.select_modalities(lines, "pose_audio", None, groups, KEYS)
    scaled = scaling.prepared(chosen, catalog.feature_names(chosen, KEYS), "norm")
    return scaled.withColumns({m: F.round(m, 6) for m in ("l_quantity", "l_tax")})


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem""")
def important_features(spark, sf_dir):
    """The table cut to the features ranked before the first big drop; here by spread."""
    lines = load(spark, sf_dir, "lineitem").select(*KEYS, *MEASURES)
    spread = [F.struct(F.lit(m).alias("feature"), F.log10(F.stddev_pop(m) + 1).alias("importance")) for m in MEASURES]
    importances = lines.agg(F.array(*spread).alias("_s")).select(F.inline("_s"))
    return significance.important_set(lines, importances, 4.0, KEYS)


USERS_SQL = """us AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id || '|42'), user_id) - 1 AS p,
  count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)),
rf AS (SELECT user_id, n, fold::INTEGER AS fold, (((p - fold * ceil(0.2::DOUBLE * n)) % n) + n) % n AS q FROM us, range(5) AS f(fold)),
fo AS (SELECT user_id, fold, CASE WHEN q < floor(0.7::DOUBLE * n) THEN 'train'
  WHEN q < floor(0.7::DOUBLE * n) + ceil(0.2::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM rf)"""


@query(f"""WITH {USERS_SQL} SELECT user_id, fold, split FROM fo""")
def rotating_split(spark, sf_dir):
    return splits.rotating_folds(load(spark, sf_dir, "events"), "user_id")


@query(f"""WITH {USERS_SQL} SELECT e.event_id, fo.split FROM events e JOIN fo ON fo.user_id = e.user_id AND fo.fold = 2""")
def split_rows(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("user_id", "event_id")
    rows = splits.apply_folds(events, splits.rotating_folds(events, "user_id"), "user_id", 2)
    return splits.require_filled(rows).select("event_id", "split")


@query(f"""WITH {USERS_SQL}, j AS (SELECT e.event_id, e.value, fo.fold, fo.split FROM events e JOIN fo ON fo.user_id = e.user_id),
m AS (SELECT fold, avg(value) AS m, stddev_pop(value) AS s FROM j WHERE split = 'train' GROUP BY fold)
SELECT j.event_id, j.fold, round((j.value - m.m) / m.s, 6) AS value FROM j JOIN m ON m.fold = j.fold""")
def standardize_per_fold(spark, sf_dir):
    """Every fold scaled by its own train rows."""
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    rows = splits.apply_folds(events, splits.rotating_folds(events, "user_id"), "user_id")
    scaled = scaling.standardize_per_fold(rows, ["value"])
    return scaled.select("event_id", "fold", F.round("value", 6).alias("value"))


@query("""
WITH e AS (SELECT user_id, fold::INTEGER AS fold FROM (SELECT DISTINCT user_id FROM events), range(5) AS f(fold)),
p AS (SELECT user_id, fold, row_number() OVER (PARTITION BY fold ORDER BY md5(user_id || '|' || (42 + fold) || '|fold'), user_id) - 1 AS p,
  count(*) OVER (PARTITION BY fold) AS n FROM e)
SELECT user_id, fold, CASE WHEN p < floor(0.7::DOUBLE * n) THEN 'train'
  WHEN p < floor(0.7::DOUBLE * n) + ceil(0.2::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM p""")
def reshuffled_split(spark, sf_dir):
    return splits.reshuffled_folds(load(spark, sf_dir, "events"), "user_id")


@query("""
WITH us AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id || '|42'), user_id) - 1 AS p, count(*) OVER () AS n
  FROM (SELECT DISTINCT user_id FROM events)),
e AS (SELECT user_id, n, fold::INTEGER AS fold, floor(p / floor(0.7::DOUBLE * n)) = fold AS train FROM us, range(5) AS f(fold)),
r AS (SELECT *, row_number() OVER (PARTITION BY fold, train ORDER BY md5(user_id || '|' || fold || '|42|rest'), user_id) - 1 AS q FROM e)
SELECT user_id, fold, CASE WHEN train THEN 'train' WHEN q < ceil(0.2::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM r""")
def block_split(spark, sf_dir):
    return splits.block_folds(load(spark, sf_dir, "events"), "user_id")


@query("""SELECT event_id, (('0x' || substring(md5(event_id || '|42'), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM events""")
def row_folds(spark, sf_dir):
    return splits.row_folds(load(spark, sf_dir, "events").select("event_id"), ["event_id"])


@query(f"""
WITH {SESSIONS_SQL}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS p,
  floor(count(*) OVER (PARTITION BY user_id) * 0.6::DOUBLE) AS tr FROM ev)
SELECT user_id, event_id, CASE WHEN p < tr THEN 'train' WHEN p < tr + floor(tr * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def within_entity_split(spark, sf_dir):
    rows = sessions(spark, sf_dir).select("user_id", "event_id", "us")
    return splits.within_entity_split(rows, "user_id", ["us", "event_id"], 0.6).drop("us")


@query("""
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '|42'), event_id) AS rn FROM events),
m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM events GROUP BY event_type))
SELECT event_id, event_type FROM r, m WHERE rn <= m.n""")
def undersample_minority(spark, sf_dir):
    return sampling.undersample_to_smallest(load(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["event_id"])


@query("""
WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5(event_id || '|42'), event_id) AS rn FROM events),
m AS (SELECT user_id, min(n) AS n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id)
SELECT event_id, r.user_id, event_type FROM r JOIN m ON m.user_id = r.user_id WHERE rn <= m.n""")
def undersample_per_entity(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return sampling.undersample_to_smallest(events, "event_type", ["event_id"], ["user_id"])


@query("""
WITH s AS (SELECT event_type, count(*) AS n, max(count(*)) OVER () AS t FROM events GROUP BY event_type),
r AS (SELECT event_id, e.event_type, row_number() OVER (PARTITION BY e.event_type ORDER BY md5(event_id || '|42'), event_id) - 1 AS p, s.n, s.t
  FROM events e JOIN s ON s.event_type = e.event_type)
SELECT event_id, event_type, unnest(range(t // n + CASE WHEN p < t % n THEN 1 ELSE 0 END))::INTEGER AS copy FROM r""")
def oversample(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.oversample_to_largest(events, "event_type", ["event_id"]).withColumn("copy", F.col("copy").cast("int"))


@query("""
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '|42'), event_id) AS rn FROM events)
SELECT event_id, event_type FROM r WHERE event_type <> 'view' OR rn <= 100""")
def undersample_target(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.resample_to(events, "event_type", {"view": 100}, ["event_id"]).drop("copy")


EMBEDDED = [f"f_{i}" for i in range(64)]


def embedded(spark, sf_dir):
    """Vectors as 64 feature columns."""
    parts = [F.get("embedding", i).cast("double").alias(f) for i, f in enumerate(EMBEDDED)]
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", *parts)


@query()
def pca_k(spark, sf_dir):
    """Components of the standardised features beyond 90 % of the variance."""
    return scaling.reduce_components(embedded(spark, sf_dir), EMBEDDED, 0.9)


@query()
def pca_centred(spark, sf_dir):
    """Components of the centred, unscaled features beyond 95 % of the variance."""
    return scaling.reduce_components(embedded(spark, sf_dir), EMBEDDED, 0.95, scale=False)


@query()
def smote(spark, sf_dir):
    """Vectors of three uneven classes, the smaller ones filled with synthetic rows."""
    kind = F.when(F.col("label") < 5, 0).when(F.col("label") < 8, 1).otherwise(2)
    return synthetic.smote(embedded(spark, sf_dir).withColumn("kind", kind), EMBEDDED, "kind", ["vec_id"])
