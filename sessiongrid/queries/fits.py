"""Models whose results are known beforehand, a training's history, tails of tests against quadrature, encoders and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessiongrid.operators import hypothesis as h
from sessiongrid.operators import models, splits
from sessiongrid.operators.aggregate import best_epoch
from sessiongrid.plans import evaluate, history
from sessiongrid.queries.base import load, query, sessions
from sessiongrid.queries.learning import REPORT_SQL, _scores
from sessiongrid.queries.preparation import USERS_SQL
from sessiongrid.queries.statistics import ANOVA_SQL, FLAGS, MEASURES, RANKS_SQL, _table, lines
from sessiongrid.session import new_path
from sessiongrid.sources import captions, store

#: the label is an exact threshold of the first group's feature, and the second group says nothing about it
KNOWN = {"pose": ["band"], "audio": ["cents"]}
EVERY = ["band", "cents"]
TEST_SQL = "te AS (SELECT event_id FROM events WHERE ('0x' || substring(md5(event_id || '|42'), 1, 8))::BIGINT % 5 = 4)"
BANDS_SQL = """bd AS (SELECT event_id, user_id, CASE WHEN band >= 5 THEN 1 ELSE 0 END AS label FROM (
  SELECT event_id, user_id, floor(coalesce(CAST(regexp_extract(props, '[0-9]+') AS DOUBLE), 0) / 10) AS band FROM events))"""
PERFECT_SQL = f"""WITH {TEST_SQL}, {BANDS_SQL}, cf AS (SELECT label AS y, label AS yhat, count(*) AS n FROM bd JOIN te USING (event_id) GROUP BY ALL), {REPORT_SQL}
SELECT sum(tp)::DOUBLE / sum(support) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM re"""


def bands(spark, sf_dir):
    """Session rows with a label that one feature decides."""
    rows = sessions(spark, sf_dir).select(
        "event_id", "user_id", "us", F.floor(F.coalesce("k", F.lit(0.0)) / 10).cast("double").alias("band"),
        F.floor(F.coalesce("value", F.lit(0.0)) * 100 % 4).cast("double").alias("cents"),
    )
    return splits.row_folds(rows.withColumn("label", (F.col("band") >= 5).cast("int")), ["event_id"])


def _parts(spark, sf_dir):
    rows = bands(spark, sf_dir)
    return rows.where("fold < 4"), rows.where("fold = 4")


@query(PERFECT_SQL)
def early_fusion_known(spark, sf_dir):
    """One tree on both groups finds the threshold."""
    return _scores(models.early_fusion(*_parts(spark, sf_dir), KNOWN, list(KNOWN), "label", models.forest(1, 3)))


@query(PERFECT_SQL)
def late_fusion_known(spark, sf_dir):
    """The mean of a certain and an undecided model goes with the certain one."""
    return _scores(models.late_fusion(*_parts(spark, sf_dir), KNOWN, list(KNOWN), "label", models.forest(1, 2)))


@query(PERFECT_SQL)
def block_fusion_known(spark, sf_dir):
    """The component of a single feature keeps its threshold, whatever its sign."""
    return _scores(models.block_fusion(*_parts(spark, sf_dir), KNOWN, list(KNOWN), "label", models.forest(1, 3)))


@query("""SELECT unnest(['all', 'no_pose', 'no_audio']) AS features, unnest([true, false, true]) AS perfect""")
def group_ablation_known(spark, sf_dir):
    """Only without the group that decides the label are there errors."""
    found = models.group_ablation(*_parts(spark, sf_dir), KNOWN, "label", models.forest(1, 3))
    return found.select("features", (F.col("accuracy") == 1.0).alias("perfect"))


@query("""SELECT unnest([1, 1, 2, 2])::INTEGER AS trees, unnest([1, 3, 1, 3])::INTEGER AS depth, 1::INTEGER AS min_leaf, 1.0::DOUBLE AS accuracy""")
def grid_search_known(spark, sf_dir):
    """Two depths and two numbers of trees, all of which find the threshold in every fold."""
    return models.grid_search(bands(spark, sf_dir), ["band"], "label", "fold", [1, 2], [1, 3])[1]


@query("""SELECT unnest(['band', 'cents']) AS feature, unnest([1.0, 0.0])::DOUBLE AS importance""")
def feature_importance_known(spark, sf_dir):
    """The deciding feature has all the importance, in every fold."""
    rows = bands(spark, sf_dir)
    parts = [models.importance_rows(spark, models.forest(1, 3)(rows.where(F.col("fold") != i), EVERY, "label"), EVERY, i) for i in range(3)]
    return models.mean_importances(parts[0].union(parts[1]).union(parts[2]))


@query(f"""WITH {TEST_SQL}, {BANDS_SQL} SELECT event_id, label::INTEGER AS label, label::INTEGER AS yhat, (1 - label)::DOUBLE AS class_0, label::DOUBLE AS class_1
FROM bd JOIN te USING (event_id)""")
def class_probabilities_known(spark, sf_dir):
    """Probabilities of a certain model are 0 and 1."""
    train, test = _parts(spark, sf_dir)
    predicted = models.predict(models.forest(1, 3)(train, EVERY, "label"), test, EVERY)
    return models.probability_columns(predicted.select("event_id", "label", "yhat", "p"), 2)


@query(f"""WITH {USERS_SQL}, {BANDS_SQL}, m AS (SELECT unnest(['accuracy', 'f1', 'precision', 'recall']) AS metric)
SELECT '0' AS config_id, fold, split, metric, 1.0::DOUBLE AS value FROM (SELECT DISTINCT fo.fold, fo.split FROM bd JOIN fo USING (user_id) WHERE split <> 'train'), m""")
def cross_validation_known(spark, sf_dir):
    """Every fold of a cross-validation by user, on an exact label, for val and test rows."""
    rows = bands(spark, sf_dir).drop("fold")
    folds = splits.rotating_folds(rows, "user_id")
    return evaluate.cross_validate(rows, folds, "user_id", ["us", "event_id"], EVERY, "label", models.forest(1, 3))


@query(f"""WITH {TEST_SQL} SELECT 0::BIGINT AS rises, true AS falls, true AS metrics_in_range, true AS best_is_greatest,
  (SELECT count(*) FROM events) - (SELECT count(*) FROM te) AS n_train, (SELECT count(*) FROM te) AS n_held""")
def training_history(spark, sf_dir):
    """Layers fitted in four steps: the loss never rises from one iteration to the next, and the best step is the greatest on held-out rows."""
    train, test = _parts(spark, sf_dir)
    made = history.train_in_steps(train, test, EVERY, "label", 2, hidden=(6,), steps=4, rounds=5).history
    loss = made.where("metric = 'loss'")
    pairs = loss.select("epoch", F.col("value").alias("now")).join(loss.select((F.col("epoch") + 1).alias("epoch"), F.col("value").alias("before")), "epoch")
    falls = pairs.agg(F.count_if(F.col("now") > F.col("before") + 1e-12).alias("rises"))
    held = made.where("metric = 'accuracy'")
    best = best_epoch(held, first_epoch=0)
    summary = held.agg(F.max("value").alias("greatest"), (F.min("value") >= 0).alias("low"), (F.max("value") <= 1).alias("high"))
    ends = loss.agg((F.min_by("value", F.col("epoch") * -1) < F.max_by("value", F.col("epoch") * -1)).alias("falls"))
    counts = bands(spark, sf_dir).agg(F.count_if(F.col("fold") < 4).alias("n_train"), F.count_if(F.col("fold") == 4).alias("n_held"))
    # tables of one row each
    one = lambda df: df.withColumn("_one", F.lit(1))
    joined = one(falls).join(one(ends), "_one").join(one(best), "_one").join(one(summary), "_one").join(one(counts), "_one")
    return joined.select(
        "rises", "falls", (F.col("low") & F.col("high")).alias("metrics_in_range"), (F.col("best_mean") == F.col("greatest")).alias("best_is_greatest"),
        "n_train", "n_held",
    )


@query(f"""WITH {RANKS_SQL},
k AS (SELECT feature, (12 / (n * (n + 1)) * (r_a * r_a / n_a + r_n * r_n / n_n + r_r * r_r / n_r) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM rs)
SELECT feature, round(exp(-h / 2), 8) AS p_value FROM k""")
def kruskal_p(spark, sf_dir):
    """With three classes the tail of H has a closed form."""
    sums = h.rank_sums(lines(spark, sf_dir), MEASURES, "l_returnflag", FLAGS)
    return h.kruskal_h(sums, 3).select("feature", F.round("p_value", 8).alias("p_value"))


#: twice the upper normal tail at ``z``, its density integrated by Simpson's rule
NORMAL_SQL = """1 - sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 4000, 2) / 2)) * z / 4000 / 3 * sqrt(2 / pi())"""


@query(f"""WITH {RANKS_SQL}, sd AS (SELECT *, n * (n + 1) / 12 - ties / (12 * (n - 1)) AS s FROM rs),
zs AS (SELECT feature, 'A' AS class_a, 'N' AS class_b, abs(r_a / n_a - r_n / n_n) / sqrt(s * (1 / n_a + 1 / n_n)) AS z FROM sd
UNION ALL SELECT feature, 'A', 'R', abs(r_a / n_a - r_r / n_r) / sqrt(s * (1 / n_a + 1 / n_r)) FROM sd
UNION ALL SELECT feature, 'N', 'R', abs(r_n / n_n - r_r / n_r) / sqrt(s * (1 / n_n + 1 / n_r)) FROM sd)
SELECT feature, class_a, class_b, round(least(3 * ({NORMAL_SQL}), 1), 6) AS p_value FROM zs, range(4001) AS r(i) GROUP BY feature, class_a, class_b, z""")
def dunn_p(spark, sf_dir):
    """Corrected p of every pair; in SQL the normal density is integrated."""
    sums = h.rank_sums(lines(spark, sf_dir), MEASURES, "l_returnflag", FLAGS)
    return h.dunn(sums, FLAGS).select("feature", "class_a", "class_b", F.round("p_value", 6).alias("p_value"))


#: the upper normal tail by the rational approximation 26.2.17 of Abramowitz and Stegun, whose coefficients these are
def _phi_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    tail = f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


@query(f"""WITH {ANOVA_SQL}, tq AS (SELECT a.feature, a.flag AS class_a, b.flag AS class_b, abs(b.m - a.m) / sqrt(msw / 2 * (1 / a.n + 1 / b.n)) AS q, dfw::DOUBLE AS df
  FROM mo a JOIN mo b ON a.feature = b.feature AND a.flag < b.flag JOIN an ON an.feature = a.feature),
sg AS (SELECT *, 1 + (i - 20) * 0.4::DOUBLE / sqrt(2 * df) AS s FROM tq, range(41) AS r(i)),
sw AS (SELECT *, exp((df - 1) * ln(s) - df * (s * s - 1) / 2) AS w FROM sg),
zz AS (SELECT feature, class_a, class_b, w, q * s AS x, -8 + j * 0.05::DOUBLE AS z FROM sw, range(321) AS r(j)),
pz AS (SELECT feature, class_a, class_b, x, w, 3 * sum(exp(-z * z / 2) / sqrt(2 * pi()) * pow({_phi_sql("z")} - {_phi_sql("(z - x)")}, 2)) * 0.05::DOUBLE AS p
  FROM zz GROUP BY feature, class_a, class_b, x, w)
SELECT feature, class_a, class_b, round(1 - sum(p * w) / sum(w), 4) AS p_value FROM pz GROUP BY feature, class_a, class_b""")
def tukey_tail(spark, sf_dir):
    """Tail of the studentised range; in SQL its double integral is summed on a grid."""
    return h.tukey_hsd(_table(spark, sf_dir), FLAGS).select("feature", "class_a", "class_b", F.round("p_value", 4).alias("p_value"))


def _load_counter():
    """An encoder of a text as its numbers of bytes, characters and blanks."""
    return lambda texts: [[float(len(t.encode())), float(len(t)), float(t.count(" "))] for t in texts]


@query("""SELECT conv_id, turn, role, [strlen(coalesce(text, ''))::DOUBLE, length(coalesce(text, ''))::DOUBLE, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE] AS vector
FROM conversations""")
def encoded_texts(spark, sf_dir):
    """Every turn with the vector of its text; equal texts are encoded once."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = captions.encode_distinct(turns, "text", _load_counter, "vector")
    return made.select("conv_id", "turn", "role", F.col("vector").cast("array<double>").alias("vector"))


@query("""SELECT s.s_suppkey, s.s_nationkey * 41 AS vec_id, embedding::DOUBLE[] AS vector FROM supplier s LEFT JOIN embeddings e ON e.vec_id = s.s_nationkey * 41""")
def vector_rows(spark, sf_dir):
    """Whole vectors of some keys, read from the folders of these keys; keys that are not stored have none."""
    path = new_path(spark)
    store.write_vectors_by_key(load(spark, sf_dir, "embeddings"), path, ["vec_id"], "embedding", buckets=64)
    wanted = load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") * 41).alias("vec_id"))
    return store.lookup_vectors(wanted, path, ["vec_id"]).select("s_suppkey", "vec_id", F.col("embedding").cast("array<double>").alias("vector"))
