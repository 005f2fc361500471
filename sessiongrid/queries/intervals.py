"""Labels, containment, as-of and masking on user sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessiongrid.operators import align, annotations, asof, intervals
from sessiongrid.operators.aggregate import label_shares
from sessiongrid.operators.rank import first_per_group
from sessiongrid.operators.ordered import row_index
from sessiongrid.queries.base import DAY, FRAMES_SQL, HOUR, SESSIONS_SQL, frames, load, query, sessions


def episodes(rows, kind: str, length: int):
    """Intervals that open at every event of a kind and last ``length`` micros."""
    return rows.where(F.col("event_type") == kind).select(
        "user_id", F.col("us").alias("start"), (F.col("us") + length).alias("end"),
        F.col("event_id").alias("seq"), F.col("value").alias("said"),
    )


def episodes_sql(kind: str, length: int) -> str:
    return f"""iv AS (SELECT user_id, us AS s, us + {length} AS e, event_id AS seq, value AS said
  FROM ev WHERE event_type = '{kind}')"""


VECTOR = 64


@query(f"""
WITH {FRAMES_SQL}, {episodes_sql("error", 12 * HOUR)},
lab AS (SELECT f.user_id, CASE WHEN EXISTS (
    SELECT 1 FROM iv WHERE iv.user_id = f.user_id AND f.us BETWEEN iv.s AND iv.e) THEN 1 ELSE 0 END AS y FROM fr f)
SELECT user_id, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END)::BIGINT AS n_0,
       sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)::BIGINT AS n_1, count(*)::BIGINT AS total,
       round(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 1) AS pct_0,
       round(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 1) AS pct_1
FROM lab GROUP BY user_id""")
def label_share_by_user(spark, sf_dir):
    rows = frames(spark, sf_dir)
    labelled = intervals.binary_label(rows, episodes(rows, "error", 12 * HOUR), ["user_id"], "us")
    return label_shares(labelled, ["user_id"], "binary_label", [0, 1])


@query(f"""
WITH {SESSIONS_SQL},
b AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us) AS k,
             lead(us) OVER (PARTITION BY user_id ORDER BY us) AS nxt FROM ev WHERE event_type = 'error')
SELECT ev.user_id, ev.event_id, coalesce(min(b.k), 0)::INTEGER AS multiclass_label
FROM ev LEFT JOIN b ON b.user_id = ev.user_id AND b.nxt IS NOT NULL AND ev.us BETWEEN b.us AND b.nxt
GROUP BY ev.user_id, ev.event_id""")
def multi_interval_label(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    bounds = rows.where("event_type = 'error'").select("user_id", "us")
    numbered = intervals.consecutive_intervals(bounds, ["user_id"], "us")
    return intervals.multiclass_label(rows, numbered, ["user_id"], "us").select("user_id", "event_id", "multiclass_label")


@query(f"""
WITH {SESSIONS_SQL}, {episodes_sql("purchase", DAY)}
SELECT user_id, event_id, CASE WHEN EXISTS (SELECT 1 FROM iv WHERE iv.user_id = ev.user_id
    AND iv.s <= ev.us AND ev.us + {HOUR} <= iv.e) THEN value END AS value FROM ev""")
def containment_filter(spark, sf_dir):
    rows = sessions(spark, sf_dir).withColumn("us_end", F.col("us") + HOUR)
    turns = episodes(rows, "purchase", DAY)
    kept = intervals.keep_contained(rows, turns, ["user_id"], "us", "us_end", ["value"])
    return kept.select("user_id", "event_id", "value")


@query(f"""
WITH {SESSIONS_SQL}, {episodes_sql("signup", 36 * HOUR)}
SELECT ev.user_id, ev.event_id, coalesce(max_by(iv.said, iv.seq), 0.0) AS said
FROM ev LEFT JOIN iv ON iv.user_id = ev.user_id AND ev.us BETWEEN iv.s AND iv.e
GROUP BY ev.user_id, ev.event_id""")
def point_in_interval_last(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    captions = episodes(rows, "signup", 36 * HOUR)
    found = intervals.lookup_interval(rows, captions, ["user_id"], "us", "start", "end", "seq", ["said"])
    return found.select("user_id", "event_id", F.coalesce("said", F.lit(0.0)).alias("said"))


@query(f"""
WITH {SESSIONS_SQL}, {episodes_sql("view", 30 * HOUR)}
SELECT ev.user_id, ev.event_id, min(iv.seq) AS seq
FROM ev LEFT JOIN iv ON iv.user_id = ev.user_id AND ev.us BETWEEN iv.s AND iv.e
GROUP BY ev.user_id, ev.event_id""")
def point_in_interval_first(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    spans = episodes(rows, "view", 30 * HOUR).withColumn("order", F.col("seq"))
    found = intervals.lookup_interval(rows, spans, ["user_id"], "us", "start", "end", "order", ["seq"], "first")
    return found.select("user_id", "event_id", "seq")


@query(f"""
WITH {FRAMES_SQL}, cap AS (
  SELECT f.user_id, f.event_id AS seq, f.frame / 30.0::DOUBLE AS s, f.frame / 30.0::DOUBLE + 0.25 AS e, m.embedding AS v
  FROM fr f JOIN embeddings m ON m.vec_id = f.event_id)
SELECT f.user_id, f.event_id, {", ".join(f"coalesce(max_by(c.v[{i + 1}], c.seq), 0)::DOUBLE AS f_{i}" for i in range(VECTOR))}
FROM fr f LEFT JOIN cap c ON c.user_id = f.user_id AND f.frame / 30.0::DOUBLE BETWEEN c.s AND c.e
GROUP BY f.user_id, f.event_id""")
def caption_vectors(spark, sf_dir):
    """Text vectors on frames: the vector of the last caption at the frame's time, zeros in silence."""
    rows = frames(spark, sf_dir)
    vectors = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("event_id"), "embedding"
    )
    at = F.col("frame") / F.lit(30.0)
    captions = rows.join(vectors, "event_id").select(
        "user_id", F.col("event_id").alias("seq"), at.alias("start_time"), (at + 0.25).alias("end_time"), "embedding"
    )
    found = intervals.attach_captions(rows, captions, ["user_id"], VECTOR)
    parts = [F.get("embedding", i).cast("double").alias(f"f_{i}") for i in range(VECTOR)]
    return found.select("user_id", "event_id", *parts)


@query(f"""
WITH {SESSIONS_SQL}, w AS (SELECT user_id, us AS e, event_id AS window_id FROM ev WHERE event_type = 'view'),
f AS (SELECT user_id, min(window_id) AS w0 FROM w GROUP BY user_id),
m AS (SELECT ev.user_id, ev.event_id, min_by(w.window_id, w.e) AS window_id
      FROM ev LEFT JOIN w ON w.user_id = ev.user_id AND w.e > ev.us GROUP BY ev.user_id, ev.event_id)
SELECT m.user_id, m.event_id, m.window_id AS window_id, coalesce(m.window_id, f.w0) AS window_id_legacy
FROM m LEFT JOIN f ON f.user_id = m.user_id""")
def forward_asof(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    windows = rows.where("event_type = 'view'").select("user_id", F.col("us").alias("end_time"), F.col("event_id").alias("window_id"))
    found = intervals.next_window(rows, windows, ["user_id"], "us")
    first = windows.groupBy("user_id").agg(F.min("window_id").alias("w0"))
    return found.join(first, "user_id", "left").select(
        "user_id", "event_id", "window_id", F.coalesce("window_id", "w0").alias("window_id_legacy")
    )


@query(f"""
WITH {SESSIONS_SQL}
SELECT user_id, event_id, greatest(floor((t - 3600.0::DOUBLE) / 1800.0::DOUBLE) + 1, 0)::BIGINT AS window_id FROM ev""")
def regular_window_asof(spark, sf_dir):
    return sessions(spark, sf_dir).select(
        "user_id", "event_id", intervals.regular_window(F.col("t"), 3600.0, 1800.0).alias("window_id")
    )


@query(f"""
WITH {SESSIONS_SQL}, w AS (SELECT DISTINCT user_id, (us // {DAY}) * {DAY} AS start_time FROM ev),
l AS (SELECT * FROM ev WHERE event_type <> 'click')
SELECT w.user_id, w.start_time, min_by(l.event_type, l.us) AS event_type
FROM w LEFT JOIN l ON l.user_id = w.user_id AND l.us >= w.start_time AND l.us < w.start_time + {DAY}
GROUP BY w.user_id, w.start_time""")
def window_first_label(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    start = F.floor(F.col("us") / F.lit(DAY)) * DAY
    windows = rows.select("user_id", start.alias("start_time")).distinct().withColumn("end_time", F.col("start_time") + DAY)
    labels = rows.where("event_type <> 'click'")
    return intervals.window_first_label(windows, labels, ["user_id"], "us", "event_type").drop("end_time")


@query(f"""
WITH {SESSIONS_SQL}, x AS (
  SELECT user_id, event_type, unnest(generate_series(greatest(floor((t - 172800) / 86400) + 1, 0)::BIGINT, floor(t / 86400)::BIGINT)) AS window_id
  FROM ev),
c AS (SELECT user_id, window_id, event_type, count(*) AS n FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_id ORDER BY n DESC, event_type) AS rn FROM c)
SELECT user_id, window_id, event_type FROM r WHERE rn = 1""")
def window_mode_label(spark, sf_dir):
    return intervals.window_mode_label(sessions(spark, sf_dir), ["user_id"], "t", "event_type", 172800.0, 86400.0)


def _numbered_errors(rows):
    errors = rows.where("event_type = 'error'").select("user_id", F.col("us").alias("start"), (F.col("us") + HOUR).alias("end"))
    return row_index(errors, ["user_id"], ["start"], "error").withColumn("error", F.col("error") + 1)


NUMBERED_SQL = f"""er AS (SELECT user_id, us AS start, us + {HOUR} AS e,
  row_number() OVER (PARTITION BY user_id ORDER BY us) AS error FROM ev WHERE event_type = 'error')"""


@query(f"""
WITH {SESSIONS_SQL}, {NUMBERED_SQL}
SELECT ev.user_id, ev.event_id, max_by(er.error, er.start) AS error
FROM ev LEFT JOIN er ON er.user_id = ev.user_id AND er.start <= ev.us
WHERE ev.event_type <> 'error' GROUP BY ev.user_id, ev.event_id""")
def backward_asof(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    errors = _numbered_errors(rows)
    found = asof.asof_join(rows.where("event_type <> 'error'"), errors, ["user_id"], "us", "start", ["error"])
    return found.select("user_id", "event_id", "error")


@query("""
WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT e.user_id, e.event_id, max_by(p.event_id, epoch_us(p.ts)::HUGEINT * 1000000000 + p.event_id) AS purchase
FROM events e LEFT JOIN p ON p.user_id = e.user_id AND p.ts <= e.ts WHERE e.event_type <> 'purchase' GROUP BY e.user_id, e.event_id""")
def timestamp_asof(spark, sf_dir):
    """The latest purchase at or before each event, by the timestamp column itself."""
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase"))
    rest = events.where("event_type <> 'purchase'")
    return asof.asof_join(rest, bought, ["user_id"], "ts", "at", ["purchase"], tiebreak="purchase").select("user_id", "event_id", "purchase")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) - 1 AS place FROM documents""")
def text_order(spark, sf_dir):
    """Positions by a text column."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return row_index(docs, ["lang"], ["source", "doc_id"], "place").select("doc_id", "place")


@query(f"""
WITH {SESSIONS_SQL}, {NUMBERED_SQL},
a AS (SELECT user_id, event_id, us, CAST(k AS BIGINT) % 5 AS error FROM ev WHERE event_type IN ('click', 'view'))
SELECT a.user_id, a.event_id, a.error, a.us - er.start AS response_time
FROM a JOIN er ON er.user_id = a.user_id AND er.error = a.error""")
def response_time_equi(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    marked = rows.where("event_type IN ('click', 'view')").select(
        "user_id", "event_id", F.col("us").alias("start"), (F.col("k").cast("long") % 5).alias("error")
    )
    found = annotations.response_times(marked, _numbered_errors(rows), ["user_id", "error"])
    return found.select("user_id", "event_id", "error", "response_time")


@query(f"""
WITH {SESSIONS_SQL}, er AS (SELECT user_id, event_id, t + 3600 AS e FROM ev WHERE event_type = 'error'),
a AS (SELECT user_id, t FROM ev WHERE event_type = 'click')
SELECT er.user_id, er.event_id, count(a.t)::BIGINT AS n_later, round(avg(a.t - er.e), 3) AS mean_response,
       round(min(a.t - er.e), 3) AS first_response
FROM er LEFT JOIN a ON a.user_id = er.user_id AND a.t > er.e GROUP BY er.user_id, er.event_id""")
def response_time_theta(spark, sf_dir):
    """Response times of all later annotations of each error, as count, mean and least value."""
    rows = sessions(spark, sf_dir)
    errors = rows.where("event_type = 'error'").select("user_id", "event_id", (F.col("t") + 3600).alias("end"))
    clicks = rows.where("event_type = 'click'").select("user_id", F.col("t").alias("start"))
    found = annotations.response_summary(clicks, errors, "user_id")
    return found.select(
        "user_id", "event_id", "n_later", F.round("mean_response", 3).alias("mean_response"),
        F.round("first_response", 3).alias("first_response"),
    )


@query(f"""
WITH {SESSIONS_SQL}, {episodes_sql("purchase", 6 * HOUR)}
SELECT user_id, event_id, value FROM ev WHERE NOT EXISTS (
  SELECT 1 FROM iv WHERE iv.user_id = ev.user_id AND iv.s <= ev.us AND ev.us < iv.e)""")
def interval_mask(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    left = intervals.mask_intervals(rows, episodes(rows, "purchase", 6 * HOUR), ["user_id"], "us")
    return left.select("user_id", "event_id", "value")


@query(f"""
WITH {SESSIONS_SQL}, {episodes_sql("purchase", 6 * HOUR)}
SELECT user_id, event_id, CASE WHEN NOT EXISTS (
  SELECT 1 FROM iv WHERE iv.user_id = ev.user_id AND iv.s <= ev.us AND ev.us < iv.e) THEN value END AS value FROM ev""")
def interval_mask_values(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    left = intervals.mask_intervals(rows, episodes(rows, "purchase", 6 * HOUR), ["user_id"], "us", ["value"])
    return left.select("user_id", "event_id", "value")


def _daily(spark, sf_dir, kind: str):
    rows = sessions(spark, sf_dir).where(F.col("event_type") == kind)
    day = F.floor(F.col("t") / F.lit(86400.0)).alias("day")
    return rows.groupBy("user_id", day).agg(F.round(F.avg("value"), 6).alias(kind))


def _daily_sql(kind: str) -> str:
    return f"""{kind}_d AS (SELECT user_id, floor(t / 86400)::BIGINT AS day, round(avg(value), 6) AS "{kind}"
  FROM ev WHERE event_type = '{kind}' GROUP BY ALL)"""


@query(f"""
WITH {SESSIONS_SQL}, {_daily_sql("click")}, {_daily_sql("view")}, {_daily_sql("purchase")}
SELECT user_id, day, click, "view", purchase FROM click_d JOIN view_d USING (user_id, day) JOIN purchase_d USING (user_id, day)""")
def inner_align(spark, sf_dir):
    return align.inner_align([_daily(spark, sf_dir, k) for k in ("click", "view", "purchase")], ["user_id", "day"])


@query(f"""
WITH {SESSIONS_SQL}, {_daily_sql("click")}, {_daily_sql("signup")}
SELECT user_id, day, click, signup FROM click_d LEFT JOIN signup_d USING (user_id, day)""")
def left_align(spark, sf_dir):
    return align.left_align(_daily(spark, sf_dir, "click"), _daily(spark, sf_dir, "signup"), ["user_id", "day"])


@query("""
SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def key_concat(spark, sf_dir):
    """Column blocks side by side by key, never by row position."""
    return align.inner_align(
        [load(spark, sf_dir, "documents").select("doc_id", "n_chars"), load(spark, sf_dir, "labels")], ["doc_id"]
    )


def _broken(spark, sf_dir):
    k = F.col("k")
    value = F.when(k < 20, None).when(k > 95, F.lit(float("inf"))).otherwise(F.col("value"))
    return sessions(spark, sf_dir).select(
        "user_id", F.floor(F.col("t") / F.lit(86400.0)).alias("day"), value.alias("value"), "k"
    )


BROKEN_SQL = f"""{SESSIONS_SQL}, br AS (SELECT user_id, floor(t / 86400)::BIGINT AS day, k,
  CASE WHEN k < 20 THEN NULL WHEN k > 95 THEN 'inf'::DOUBLE ELSE value END AS value FROM ev)"""


@query(f"""
WITH {BROKEN_SQL}
SELECT user_id, day, round(avg(CASE WHEN value IS NULL OR isinf(value) THEN 0 ELSE value END), 6) AS value, round(avg(k), 6) AS k
FROM br GROUP BY user_id, day""")
def frame_mean(spark, sf_dir):
    means = align.frame_means(_broken(spark, sf_dir), ["user_id", "day"])
    return means.select("user_id", "day", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"))


@query(f"""
WITH {BROKEN_SQL}
SELECT user_id, day, round(avg(CASE WHEN isinf(value) THEN NULL ELSE value END), 6) AS value, round(avg(k), 6) AS k
FROM br GROUP BY user_id, day""")
def frame_mean_ignoring_gaps(spark, sf_dir):
    means = align.frame_means(_broken(spark, sf_dir), ["user_id", "day"], "ignore")
    return means.select("user_id", "day", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"))


@query(f"""
WITH {SESSIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS rn FROM ev)
SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1""")
def first_match(spark, sf_dir):
    rows = sessions(spark, sf_dir).select("user_id", "event_type", "us", "event_id", "value")
    return first_per_group(rows, ["user_id", "event_type"], ["us", "event_id"]).drop("us")


@query("""
SELECT e.vec_id, e.label, l.quality FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id""")
def entity_label_join(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    return align.inner_align([vectors, labels], ["vec_id"])


@query("""SELECT e.vec_id, e.label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id)""")
def unmatched_entities(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    return align.missing_keys(vectors, load(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), ["vec_id"])
