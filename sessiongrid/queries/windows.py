"""Deltas, windows and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessiongrid.operators import rank, windows
from sessiongrid.queries.base import FRAMES_SQL, SESSIONS_SQL, frames, load, query, sessions

ORDER = ["us", "event_id"]


def _window_text(x):
    """Values of a window's first feature, in hundredths, joined; comparable as text."""
    return F.array_join(F.transform(x, lambda row: F.round(F.get(row, 0) * 100).cast("long").cast("string")), ",")


@query(f"""
WITH {FRAMES_SQL}
SELECT user_id, event_id, value, k,
  round(coalesce(value - lag(value) OVER w, 0), 4) AS value_delta, round(coalesce(k - lag(k) OVER w, 0), 4) AS k_delta
FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""")
def frame_delta(spark, sf_dir):
    rows = sessions(spark, sf_dir).select("user_id", "event_id", "us", "value", "k")
    return windows.frame_deltas(rows, ["user_id"], ORDER, ["value", "k"]).drop("us")


@query(f"""
WITH {FRAMES_SQL}, w AS (SELECT user_id, us, event_id, event_type, count(*) OVER w AS n,
  string_agg((round(value * 100)::BIGINT)::VARCHAR, ',') OVER w AS "window"
  FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT user_id, us, event_id, event_type, "window" FROM w WHERE n = 5""")
def sliding_seq(spark, sf_dir):
    made = windows.sliding_sequences(sessions(spark, sf_dir), ["user_id"], ORDER, 5, ["value", "k"], "event_type")
    return made.select("user_id", *ORDER, "event_type", _window_text(F.col("x")).alias("window"))


@query(f"""
WITH {FRAMES_SQL}, w AS (SELECT user_id, us, event_id, event_type, frame, lag(value, 2) OVER w AS f_0, lag(k, 2) OVER w AS f_1,
  lag(value) OVER w AS f_2, lag(k) OVER w AS f_3, value AS f_4, k AS f_5 FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT * EXCLUDE (frame) FROM w WHERE frame >= 2""")
def flat_windows(spark, sf_dir):
    """Windows of three rows as flat feature columns."""
    made = windows.sliding_sequences(sessions(spark, sf_dir), ["user_id"], ORDER, 3, ["value", "k"], "event_type")
    return windows.flat_windows(made, 3, 2)


@query(f"""
WITH {FRAMES_SQL}, kept AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS p FROM fr WHERE k >= 10),
w AS (SELECT user_id, event_id, event_type, frame, count(*) OVER w AS n, first_value(frame) OVER w AS f0
  FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT user_id, frame, event_type FROM w WHERE n = 4 AND frame - f0 = 3""")
def sliding_seq_contiguous(spark, sf_dir):
    """Windows over rows with frame gaps, broken ones left out."""
    rows = frames(spark, sf_dir).where("k >= 10")
    made = windows.sliding_sequences(
        rows, ["user_id"], ["frame"], 4, ["value"], "event_type", frame="frame", require_contiguous=True
    )
    return made.select("user_id", "frame", "event_type")


@query(f"""
WITH {FRAMES_SQL}, n AS (SELECT user_id, count(*) AS n FROM fr GROUP BY user_id),
s AS (SELECT user_id, n, unnest(generate_series(0, n, 3)) AS i FROM n)
SELECT s.user_id, s.i // 3 AS window_id, max_by(f.event_type, f.frame) AS event_type,
  string_agg((round(f.value * 100)::BIGINT)::VARCHAR, ',' ORDER BY f.frame) AS "window"
FROM s JOIN fr f ON f.user_id = s.user_id AND f.frame >= s.i AND f.frame < s.i + 6
WHERE s.i + 6 <= s.n GROUP BY s.user_id, s.i""")
def strided_windows(spark, sf_dir):
    """Windows of 4 rows behind 2 rows of context, every 3 rows."""
    made = windows.strided_windows(sessions(spark, sf_dir), ["user_id"], ORDER, 4, 3, ["value"], "event_type", context=2)
    return made.select("user_id", "window_id", "event_type", _window_text(F.col("x")).alias("window"))


@query(f"""
WITH {FRAMES_SQL}, w AS (SELECT user_id, us, event_id, event_type, count(*) OVER w AS n,
  round(avg(value) OVER w, 6) AS value_mean, round(stddev_pop(value) OVER w, 6) AS value_sd, min(value) OVER w AS value_min,
  max(value) OVER w AS value_max, value AS value_last, round(regr_slope(value, frame) OVER w, 6) AS value_slope
  FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT * EXCLUDE (n) FROM w WHERE n = 10""")
def window_summaries(spark, sf_dir):
    made = windows.window_summaries(sessions(spark, sf_dir), ["user_id"], ORDER, 10, ["value"], "event_type")
    return made.withColumns({c: F.round(c, 6) for c in ("value_mean", "value_sd", "value_slope")})


CALLS_SQL = f"""{FRAMES_SQL}, pr AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
  CASE WHEN k >= 70 THEN 1 ELSE 0 END AS yhat FROM fr)"""


def calls(spark, sf_dir):
    """Predictions on session rows: is the event an error, guessed from ``k``."""
    y = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return sessions(spark, sf_dir).withColumns({"y": y, "yhat": F.when(F.col("k") >= 70, 1).otherwise(0)})


@query(f"""
WITH {CALLS_SQL}
SELECT user_id, event_id, CASE WHEN yhat = y OR yhat = lag(y, 1) OVER w OR yhat = lead(y, 1) OVER w
  OR yhat = lag(y, 2) OVER w OR yhat = lead(y, 2) OVER w THEN y ELSE yhat END AS tolerant
FROM pr WINDOW w AS (PARTITION BY user_id ORDER BY frame)""")
def tolerant_pred(spark, sf_dir):
    return windows.tolerant_predictions(calls(spark, sf_dir), ["user_id"], ORDER, "y", "yhat", 2).select(
        "user_id", "event_id", "tolerant"
    )


@query(f"""
WITH {SESSIONS_SQL}, e AS (SELECT user_id, max(t) AS last FROM ev GROUP BY user_id),
x AS (SELECT user_id, value, unnest(generate_series(greatest(floor((t - 172800) / 86400) + 1, 0)::BIGINT, floor(t / 86400)::BIGINT)) AS window_id FROM ev)
SELECT x.user_id, window_id, round(avg(value), 6) AS mean, count(*)::BIGINT AS n, window_id * 86400.0::DOUBLE AS start_time,
  window_id * 86400.0::DOUBLE + 172800 AS end_time
FROM x JOIN e ON e.user_id = x.user_id WHERE window_id * 86400 + 172800 <= e.last GROUP BY x.user_id, window_id""")
def hop_windows(spark, sf_dir):
    """Two-day windows every day, with mean and count."""
    picks = {"mean": F.round(F.avg("value"), 6), "n": F.count(F.lit(1))}
    return windows.hop_windows(sessions(spark, sf_dir), ["user_id"], "t", 172800.0, 86400.0, picks)


@query(f"""
WITH {FRAMES_SQL}, n AS (SELECT user_id, count(*) AS n FROM fr GROUP BY user_id),
s AS (SELECT user_id, n, unnest(generate_series(0, n, 2)) AS i FROM n),
p AS (SELECT s.user_id, s.i // 2 AS j, f.k::BIGINT % 3 AS yhat FROM s JOIN fr f ON f.user_id = s.user_id AND f.frame = s.i + 3 WHERE s.i + 4 <= s.n)
SELECT f.user_id, f.event_id, coalesce(p.yhat, 0) AS yhat
FROM fr f LEFT JOIN p ON p.user_id = f.user_id AND p.j = CASE WHEN f.frame < 2 THEN 0 ELSE (f.frame - 2) // 2 + 1 END""")
def unroll_windows(spark, sf_dir):
    """A prediction per window of 4 rows, every 2 rows, spread back over the rows."""
    rows = frames(spark, sf_dir).withColumn("code", F.col("k").cast("long") % 3)
    made = windows.strided_windows(rows, ["user_id"], ["frame"], 4, 2, ["value"], "code")
    predictions = made.select("user_id", "window_id", F.col("code").alias("yhat"))
    return windows.unroll_windows(rows, predictions, ["user_id"], "frame", "yhat", 4, 2).select("user_id", "event_id", "yhat")


@query("""
WITH t AS (SELECT conv_id, turn, role, turn * 40.0::DOUBLE AS s, turn * 40.0::DOUBLE + length(text) / 10.0::DOUBLE AS e FROM conversations),
n AS (SELECT *, lead(role) OVER w AS r2, lead(s) OVER w AS s2 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY s, e))
SELECT conv_id, turn, round(greatest(s2 - e, 0), 6) AS gap FROM n WHERE r2 <> role""")
def turn_gap(spark, sf_dir):
    start = F.col("turn") * F.lit(40.0)
    turns = load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("speaker"), start.alias("start"),
        (start + F.length("text") / F.lit(10.0)).alias("end"),
    )
    return windows.turn_gaps(turns, ["conv_id"]).select("conv_id", "turn", F.round("gap", 6).alias("gap"))


@query("""
WITH c AS (SELECT event_type, value, count(*) AS ties FROM events GROUP BY ALL)
SELECT event_type, value, ties, (sum(ties) OVER w - ties)::BIGINT AS before,
  (sum(ties) OVER w - ties)::DOUBLE + (ties + 1) / 2.0::DOUBLE AS midrank
FROM c WINDOW w AS (PARTITION BY event_type ORDER BY value)""")
def mid_rank(spark, sf_dir):
    return rank.midranks(load(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")


IMPORTANCE_SQL = """im AS (SELECT o_custkey::VARCHAR AS feature, count(*)::DOUBLE AS importance FROM orders GROUP BY o_custkey),
dr AS (SELECT feature, importance, row_number() OVER w - 1 AS rank, abs(importance / lead(importance) OVER w - 1) AS importance_drop
  FROM im WINDOW w AS (ORDER BY importance DESC, feature))"""


def _importances(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").cast("string").alias("feature")).agg(
        F.count(F.lit(1)).cast("double").alias("importance")
    )


@query(f"""WITH {IMPORTANCE_SQL} SELECT feature, importance, rank, round(importance_drop, 9) AS importance_drop FROM dr""")
def ranked_drops(spark, sf_dir):
    return rank.ranked_drops(_importances(spark, sf_dir)).withColumn("importance_drop", F.round("importance_drop", 9))


@query(f"""WITH {IMPORTANCE_SQL}
SELECT feature, importance FROM dr WHERE rank < (SELECT min(rank) FROM dr WHERE importance_drop > 0.3)""")
def pct_drop_cut(spark, sf_dir):
    return rank.cut_at_drop(rank.ranked_drops(_importances(spark, sf_dir)), 0.3).select("feature", "importance")


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
  round(quantile_cont(l_extendedprice, 0.99), 4) AS q99 FROM lineitem GROUP BY l_returnflag""")
def exact_quantiles(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    found = rank.exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.99])
    return found.select("l_returnflag", *[F.round(F.get("quantiles", i), 4).alias(n) for i, n in enumerate(("q10", "q50", "q99"))])
