"""Hypothesis tests on line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessiongrid.operators import hypothesis as h
from sessiongrid.operators.clean import exclude_classes
from sessiongrid.plans import significance
from sessiongrid.queries.base import MEASURES, load, query

FLAGS = ["A", "N", "R"]
LONG_SQL = "lg AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS feature, l_returnflag AS flag, l_linestatus AS status, {m} AS v FROM lineitem" for m in MEASURES
) + ")"
RANKS_SQL = f"""{LONG_SQL},
c AS (SELECT feature, v, count(*) AS t, count_if(flag = 'A') AS a, count_if(flag = 'N') AS n, count_if(flag = 'R') AS r FROM lg GROUP BY ALL),
rk AS (SELECT *, sum(t) OVER (PARTITION BY feature ORDER BY v) - t + (t + 1) / 2.0::DOUBLE AS mr FROM c),
rs AS (SELECT feature, sum(t)::DOUBLE AS n, sum(t::DOUBLE * t * t - t) AS ties,
  sum(a)::DOUBLE AS n_a, sum(n)::DOUBLE AS n_n, sum(r)::DOUBLE AS n_r, sum(mr * a) AS r_a, sum(mr * n) AS r_n, sum(mr * r) AS r_r FROM rk GROUP BY feature)"""


def lines(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", *MEASURES)


def _table(spark, sf_dir):
    return h.class_table(h.class_moments(lines(spark, sf_dir), MEASURES, "l_returnflag"), FLAGS)


def rounded(table, **places):
    return table.withColumns({name: F.round(name, digits) for name, digits in places.items()})


@query(f"""WITH {LONG_SQL}, m AS (SELECT feature, status, count(*)::DOUBLE AS n, avg(v) AS m, var_samp(v) AS s FROM lg GROUP BY ALL),
p AS (SELECT a.feature, a.m - b.m AS d, a.s / a.n AS x, b.s / b.n AS y, a.n AS na, b.n AS nb FROM m a JOIN m b ON a.feature = b.feature
  AND a.status = 'F' AND b.status = 'O')
SELECT feature, round(d / sqrt(x + y), 6) AS t, round((x + y) * (x + y) / (x * x / (na - 1) + y * y / (nb - 1)), 3) AS df FROM p""")
def welch_t(spark, sf_dir):
    return rounded(h.welch_t(lines(spark, sf_dir), MEASURES, "l_linestatus", "F", "O", p_value=False), t=6, df=3)


@query(f"""WITH {LONG_SQL}, m AS (SELECT feature, status, count(*)::DOUBLE AS n, avg(v) AS m, var_samp(v) AS s FROM lg GROUP BY ALL),
p AS (SELECT a.feature, a.m - b.m AS d, a.s / a.n AS x, b.s / b.n AS y, a.n AS na, b.n AS nb FROM m a JOIN m b ON a.feature = b.feature
  AND a.status = 'F' AND b.status = 'O'),
t AS (SELECT feature, abs(d / sqrt(x + y)) AS t, (x + y) * (x + y) / (x * x / (na - 1) + y * y / (nb - 1)) AS df FROM p),
ps AS (SELECT feature, 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * t / 4000 / 3
    * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - (df + 1) / 2 * ln(1 + pow(t * i / 4000, 2) / df)) / sqrt(df * pi())) AS p
  FROM t, range(4001) AS r(i) GROUP BY feature)
SELECT feature, round(p, 6) AS p_value, round(p * 4, 5) AS corrected FROM ps""")
def welch_p(spark, sf_dir):
    """The t tail; in SQL its density is integrated by Simpson's rule."""
    tested = h.welch_t(lines(spark, sf_dir), MEASURES, "l_linestatus", "F", "O")
    corrected = h.bonferroni(F.col("p_value"), len(MEASURES)).alias("corrected")
    return rounded(tested.select("feature", "p_value", corrected), p_value=6, corrected=5)


MOMENTS_SQL = f"""{LONG_SQL}, mu AS (SELECT feature, avg(v) AS m FROM lg GROUP BY feature),
mo AS (SELECT lg.feature, count(*)::DOUBLE AS n, avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS s,
  avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3 AS k FROM lg JOIN mu ON mu.feature = lg.feature GROUP BY lg.feature)"""


@query(f"""WITH {MOMENTS_SQL}
SELECT feature, n::BIGINT AS n, round(s, 6) AS skewness, round(k, 6) AS kurtosis, round(n / 6 * (s * s + k * k / 4), 2) AS jb,
  round(exp(-n / 12 * (s * s + k * k / 4)), 6) AS p_value FROM mo""")
def jarque_bera(spark, sf_dir):
    return rounded(h.jarque_bera(lines(spark, sf_dir), MEASURES), skewness=6, kurtosis=6, jb=2, p_value=6)


@query("""
WITH u AS (SELECT 'event' || event_type AS feature, (value - (SELECT avg(value) FROM events)) AS v FROM events),
z AS (SELECT feature, abs(avg(v)) / 10 AS p_value FROM u GROUP BY feature)
SELECT feature, round(p_value * 5, 9) AS raw, round(least(p_value * 5, 1), 9) AS clipped FROM z""")
def bonferroni(spark, sf_dir):
    """Corrected values, with and without the bound of 1."""
    events = load(spark, sf_dir, "events")
    mean = events.agg(F.avg("value")).first()[0]
    p = events.groupBy(F.concat(F.lit("event"), F.col("event_type")).alias("feature")).agg(
        (F.abs(F.avg(F.col("value") - mean)) / 10).alias("p_value")
    )
    raw, clipped = h.bonferroni(F.col("p_value"), 5), h.bonferroni(F.col("p_value"), 5, clip=True)
    return p.select("feature", F.round(raw, 9).alias("raw"), F.round(clipped, 9).alias("clipped"))


@query(f"""WITH {MOMENTS_SQL}, pv AS (SELECT feature, exp(-n / 12 * (s * s + k * k / 4)) AS p FROM mo)
SELECT feature, round(p * 4, 9) AS p_value FROM pv WHERE p * 4 < 0.05""")
def significant_features(spark, sf_dir):
    """Features that are not normal after correction."""
    return rounded(h.significant(h.jarque_bera(lines(spark, sf_dir), MEASURES), len(MEASURES)), p_value=9)


@query(f"""WITH {RANKS_SQL}
SELECT feature, round((12 / (n * (n + 1)) * (r_a * r_a / n_a + r_n * r_n / n_n + r_r * r_r / n_r) - 3 * (n + 1))
  / (1 - ties / (n * n * n - n)), 5) AS h FROM rs""")
def kruskal_h(spark, sf_dir):
    sums = h.rank_sums(lines(spark, sf_dir), MEASURES, "l_returnflag", FLAGS)
    return rounded(h.kruskal_h(sums, 3, p_value=False).select("feature", "h"), h=5)


@query(f"""WITH {RANKS_SQL}, sd AS (SELECT *, n * (n + 1) / 12 - ties / (12 * (n - 1)) AS s FROM rs)
SELECT feature, 'A' AS class_a, 'N' AS class_b, round((r_a / n_a - r_n / n_n) / sqrt(s * (1 / n_a + 1 / n_n)), 6) AS z FROM sd
UNION ALL SELECT feature, 'A', 'R', round((r_a / n_a - r_r / n_r) / sqrt(s * (1 / n_a + 1 / n_r)), 6) FROM sd
UNION ALL SELECT feature, 'N', 'R', round((r_n / n_n - r_r / n_r) / sqrt(s * (1 / n_n + 1 / n_r)), 6) FROM sd""")
def dunn_z(spark, sf_dir):
    sums = h.rank_sums(lines(spark, sf_dir), MEASURES, "l_returnflag", FLAGS)
    return rounded(h.dunn(sums, FLAGS, p_value=False), z=6)


@query()
def kruskal_starred(spark, sf_dir):
    """Corrected p with stars for each pair of event kinds, value and number as features."""
    events = load(spark, sf_dir, "events").select(
        "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.length("event_type").cast("double").alias("name_length"),
    )
    return significance.kruskal_table(events, ["value", "k", "name_length"], "event_type", ("error", "signup"))


ANOVA_SQL = f"""{LONG_SQL}, mo AS (SELECT feature, flag, count(*)::DOUBLE AS n, avg(v) AS m, var_samp(v) AS s FROM lg GROUP BY ALL),
gm AS (SELECT feature, sum(n * m) / sum(n) AS g, sum(n) AS n FROM mo GROUP BY feature),
an AS (SELECT mo.feature, sum(mo.n * (m - g) * (m - g)) / 2 AS msb, sum((mo.n - 1) * s) / (max(gm.n) - 3) AS msw, max(gm.n) - 3 AS dfw
  FROM mo JOIN gm ON gm.feature = mo.feature GROUP BY mo.feature)"""


@query(f"""WITH {ANOVA_SQL} SELECT feature, round(msb / msw, 6) AS f, dfw::BIGINT AS df_within FROM an""")
def anova_f(spark, sf_dir):
    return rounded(h.anova_f(_table(spark, sf_dir), p_value=False).select("feature", "f", "df_within"), f=6)


@query(f"""WITH {ANOVA_SQL}
SELECT a.feature, a.flag AS class_a, b.flag AS class_b, round(abs(b.m - a.m) / sqrt(msw / 2 * (1 / a.n + 1 / b.n)), 6) AS q
FROM mo a JOIN mo b ON a.feature = b.feature AND a.flag < b.flag JOIN an ON an.feature = a.feature""")
def tukey_q(spark, sf_dir):
    return rounded(h.tukey_hsd(_table(spark, sf_dir), FLAGS, p_value=False).drop("mean_diff"), q=6)


@query(f"""WITH {ANOVA_SQL}
SELECT feature, round(msb / msw, 6) AS f, 2::INTEGER AS df_between, dfw::BIGINT AS df_within, round(msw, 4) AS ms_within,
  round(pow(dfw / (dfw + 2 * msb / msw), dfw / 2), 8) AS p_value FROM an""")
def anova_p(spark, sf_dir):
    """With three classes the F tail has a closed form."""
    return rounded(h.anova_f(_table(spark, sf_dir)), f=6, ms_within=4, p_value=8)


@query()
def tukey_p(spark, sf_dir):
    return h.tukey_hsd(_table(spark, sf_dir), FLAGS)


@query()
def shapiro_wilk(spark, sf_dir):
    """W per event kind over all rows."""
    return h.shapiro_wilk(load(spark, sf_dir, "events"), ["value"], "event_type")


@query("""SELECT l_returnflag, l_linestatus, l_quantity, l_tax FROM lineitem WHERE l_returnflag NOT IN ('N')""")
def multiclass_subset(spark, sf_dir):
    kept = exclude_classes(lines(spark, sf_dir), "l_returnflag", ["N"])
    return kept.drop("l_extendedprice", "l_discount")
