"""Hypothesis tests per feature.

Moment tests read the wide table once with one aggregate per class. Rank tests collapse equal
values first and take ranks from a blocked running count. Everything after that works on one row
per feature, where the tail probabilities are computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongrid.functions import tails
from sessiongrid.functions.text import stars
from sessiongrid.operators.ordered import Blocks, column, row_index
from sessiongrid.operators.rank import long_values, value_counts_ranked


# Division that gives null where the divisor is 0: a constant feature or an empty class has no test.
ratio = F.try_divide


def class_list(df: DataFrame, label: str) -> list:
    """Classes present, in order."""
    return sorted(r[0] for r in df.select(column(label)).where(column(label).isNotNull()).distinct().collect())


def class_moments(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows ``(class, feature, n, mean, var)`` from one pass over the wide table."""
    stats = [
        F.struct(
            F.lit(f).alias("feature"),
            F.count(column(f)).alias("n"),
            F.avg(column(f)).alias("mean"),
            F.var_samp(column(f)).alias("var"),
        )
        for f in features
    ]
    grouped = df.where(column(label).isNotNull()).groupBy(column(label).alias("class"))
    return grouped.agg(F.array(*stats).alias("_s")).select("class", F.inline("_s"))


def by_class(moments: DataFrame, classes: Sequence, names: Sequence[str]) -> DataFrame:
    """One row per feature with ``<name>_<i>`` for the i-th class."""
    picks = [
        F.max(F.when(F.col("class") == F.lit(c), F.col(name))).alias(f"{name}_{i}")
        for i, c in enumerate(classes)
        for name in names
    ]
    return moments.groupBy("feature").agg(*picks)


def welch_t(
    df: DataFrame, features: Sequence[str], label: str, low: object = 0, high: object = 1, p_value: bool = True
) -> DataFrame:
    """Welch's t-test of class ``low`` against ``high``: ``feature, t, df, p_value``."""
    two = df.where(column(label).isin(low, high))
    wide = by_class(class_moments(two, features, label), [low, high], ["n", "mean", "var"])
    a, b = ratio(F.col("var_0"), F.col("n_0")), ratio(F.col("var_1"), F.col("n_1"))
    spread = ratio(a * a, F.col("n_0") - 1) + ratio(b * b, F.col("n_1") - 1)
    freedom = ratio((a + b) * (a + b), spread)
    tested = wide.select(
        "feature", ratio(F.col("mean_0") - F.col("mean_1"), F.sqrt(a + b)).alias("t"), freedom.alias("df")
    )
    return tested.withColumn("p_value", tails.on_results(tails.t_two_sided, F.col("t"), F.col("df"))) if p_value else tested


def bonferroni(p: Column, tests: int, clip: bool = False) -> Column:
    """p times the number of tests, above 1 unless ``clip``."""
    corrected = p * F.lit(tests)
    return F.least(corrected, F.lit(1.0)) if clip else corrected


def significant(results: DataFrame, tests: int, alpha: float = 0.05) -> DataFrame:
    """``feature, p_value`` of the features whose corrected p is below ``alpha``."""
    corrected = results.withColumn("p_value", bonferroni(F.col("p_value"), tests))
    return corrected.where(F.col("p_value") < alpha).select("feature", "p_value")


def rank_sums(
    df: DataFrame, features: Sequence[str], label: str, classes: Sequence, blocks: Blocks | None = None
) -> DataFrame:
    """Per feature: ``n``, tie term ``ties`` and for the i-th class ``n_<i>`` and rank sum ``r_<i>``."""
    long = long_values(df.where(column(label).isin(*classes)), features, [label])
    counts = [F.count_if(column(label) == F.lit(c)).alias(f"c_{i}") for i, c in enumerate(classes)]
    ranked = value_counts_ranked(long, ["feature"], "value", counts, blocks)
    t = F.col("ties").cast("double")
    sums = [F.sum(f"c_{i}").alias(f"n_{i}") for i in range(len(classes))]
    sums += [F.sum(F.col("midrank") * F.col(f"c_{i}")).alias(f"r_{i}") for i in range(len(classes))]
    return ranked.groupBy("feature").agg(F.sum("ties").alias("n"), F.sum(t * t * t - t).alias("ties"), *sums)


def kruskal_h(sums: DataFrame, classes: int, p_value: bool = True) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H from :func:`rank_sums`."""
    n = F.col("n").cast("double")
    squares = sum(
        (ratio(F.col(f"r_{i}") * F.col(f"r_{i}"), F.col(f"n_{i}")) for i in range(1, classes)),
        ratio(F.col("r_0") * F.col("r_0"), F.col("n_0")),
    )
    raw = squares * 12 / (n * (n + 1)) - (n + 1) * 3
    share = F.lit(1.0) - ratio(F.col("ties"), n * n * n - n)
    tested = sums.withColumn("h", F.when(share > 0, raw / share))
    if not p_value:
        return tested
    return tested.withColumn("p_value", tails.on_results(tails.chi2_upper, F.col("h"), F.lit(classes - 1)))


def _dunn_pairs(classes: Sequence) -> list[tuple[object, object, Column]]:
    """Every pair of classes with its z, from a row of :func:`rank_sums`."""
    n = F.col("n").cast("double")
    spread = n * (n + 1) / 12 - ratio(F.col("ties"), (n - 1) * 12)
    pairs = []
    for a, b in combinations(range(len(classes)), 2):
        difference = ratio(F.col(f"r_{a}"), F.col(f"n_{a}")) - ratio(F.col(f"r_{b}"), F.col(f"n_{b}"))
        error = F.sqrt(spread * (ratio(F.lit(1.0), F.col(f"n_{a}")) + ratio(F.lit(1.0), F.col(f"n_{b}"))))
        pairs.append((classes[a], classes[b], ratio(difference, error)))
    return pairs


def dunn(sums: DataFrame, classes: Sequence, p_value: bool = True) -> DataFrame:
    """Dunn's z per pair of classes from :func:`rank_sums`, p with Bonferroni over pairs, at most 1."""
    pairs = _dunn_pairs(classes)
    rows = [F.struct(F.lit(a).alias("class_a"), F.lit(b).alias("class_b"), z.alias("z")) for a, b, z in pairs]
    tested = sums.select("feature", F.inline(F.array(*rows)))
    if not p_value:
        return tested
    p = tails.on_results(tails.normal_two_sided, F.col("z"))
    return tested.withColumn("p_value", F.least(p * len(pairs), F.lit(1.0)))


def starred_table(sums: DataFrame, classes: Sequence, tests: int, alpha: float = 0.05) -> DataFrame:
    """Significant features of :func:`rank_sums` with corrected p and stars per pair of classes.

    All in the one row per feature: ``feature, p_value`` (3 decimals), ``dunn_<a>_<b>``.
    """
    corrected = bonferroni(F.col("p_value"), tests)
    chosen = kruskal_h(sums, len(classes)).where(corrected < alpha)
    pairs = _dunn_pairs(classes)
    marks = {
        f"dunn_{a}_{b}": stars(F.least(tails.on_results(tails.normal_two_sided, z) * len(pairs), F.lit(1.0)))
        for a, b, z in pairs
    }
    return chosen.select("feature", F.round(corrected, 3).alias("p_value"), *[m.alias(name) for name, m in marks.items()])


def class_table(moments: DataFrame, classes: Sequence) -> DataFrame:
    """One row per feature: n, mean and variance of each class, and the one-way ANOVA of them.

    Returns ``f, df_between, df_within, ms_within`` beside ``n_<i>, mean_<i>, var_<i>``.
    """
    places = range(len(classes))
    k = len(classes)
    n = [F.coalesce(F.col(f"n_{i}"), F.lit(0)) for i in places]
    weighted = [F.coalesce(n[i] * F.col(f"mean_{i}"), F.lit(0.0)) for i in places]
    total, grand = _sum(n), ratio(_sum(weighted), _sum(n))
    away = [F.col(f"mean_{i}") - grand for i in places]
    between = _sum([F.coalesce(n[i] * away[i] * away[i], F.lit(0.0)) for i in places])
    within = _sum([F.coalesce((n[i] - 1) * F.col(f"var_{i}"), F.lit(0.0)) for i in places])
    return (
        by_class(moments, classes, ["n", "mean", "var"])
        .withColumn("df_between", F.lit(k - 1))
        .withColumn("df_within", total - k)
        .withColumn("ms_within", ratio(within, F.col("df_within")))
        .withColumn("f", ratio(between, F.col("ms_within") * (k - 1)))
    )


def _sum(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0])


def _anova_p() -> Column:
    return tails.on_results(tails.f_upper, F.col("f"), F.col("df_between"), F.col("df_within"))


def anova_f(table: DataFrame, p_value: bool = True) -> DataFrame:
    """One-way ANOVA per feature from :func:`class_table`."""
    tested = table.select("feature", "f", "df_between", "df_within", "ms_within")
    return tested.withColumn("p_value", _anova_p()) if p_value else tested


def tukey_hsd(table: DataFrame, classes: Sequence, p_value: bool = True, alpha: float | None = None, tests: int = 1) -> DataFrame:
    """Tukey-Kramer per pair of classes from :func:`class_table`: mean difference, q, p.

    ``alpha`` keeps the features whose ANOVA is significant after correction for ``tests``.
    """
    if alpha is not None:
        table = table.withColumn("_p", _anova_p()).where(bonferroni(F.col("_p"), tests) < alpha)
    rows = []
    for a, b in combinations(range(len(classes)), 2):
        difference = F.col(f"mean_{b}") - F.col(f"mean_{a}")
        error = F.sqrt(
            F.col("ms_within") / 2 * (ratio(F.lit(1.0), F.col(f"n_{a}")) + ratio(F.lit(1.0), F.col(f"n_{b}")))
        )
        rows.append(
            F.struct(
                F.lit(classes[a]).alias("class_a"), F.lit(classes[b]).alias("class_b"),
                difference.alias("mean_diff"), ratio(F.abs(difference), error).alias("q"),
            )
        )
    tested = table.select("feature", "df_within", F.inline(F.array(*rows)))
    if p_value:
        k = F.lit(len(classes))
        p = tails.on_results(tails.studentized_range_upper, F.col("q"), k, F.col("df_within"))
        tested = tested.withColumn("p_value", p)
    return tested.drop("df_within")


def jarque_bera(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Skewness, excess kurtosis, n and the Jarque-Bera p per feature (and class)."""
    stats = [
        F.struct(
            F.lit(f).alias("feature"),
            F.count(column(f)).alias("n"),
            F.skewness(column(f)).alias("skewness"),
            F.kurtosis(column(f)).alias("kurtosis"),
        )
        for f in features
    ]
    groups = [column(label).alias("class")] if label else []
    names = ["class"] if label else []
    rows = df.groupBy(*groups).agg(F.array(*stats).alias("_s")).select(*names, F.inline("_s"))
    s, k = F.col("skewness"), F.col("kurtosis")
    return rows.withColumn("jb", F.col("n") / 6.0 * (s * s + k * k / 4.0)).withColumn(
        "p_value", F.exp(-F.col("jb") / 2.0)
    )


# Rational approximation of the normal quantile (AS 241, seven digits) and the
# polynomials for the two outer weights of the W statistic.
QUANTILE_CENTRE = ((3.3871327179, 50.434271938, 159.29113202, 59.109374720), (1.0, 17.895169469, 78.757757664, 67.187563600))
QUANTILE_TAIL = ((1.4234372777, 2.7568153900, 1.3067284816, 0.17023821103), (1.0, 0.73700164250, 0.12021132975))
QUANTILE_FAR = ((6.6579051150, 3.0812263860, 0.42868294337, 0.017337203997), (1.0, 0.24197894225, 0.012258202635))
OUTER_WEIGHT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SECOND_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def _ratio(pair, x: Column) -> Column:
    return _polynomial(pair[0], x) / _polynomial(pair[1], x)


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal as a column expression, about seven digits."""
    q = p - 0.5
    centre = q * _ratio(QUANTILE_CENTRE, F.lit(0.180625) - q * q)
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(r <= 5, _ratio(QUANTILE_TAIL, r - 1.6)).otherwise(_ratio(QUANTILE_FAR, r - 5.0))
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * outer)


def shapiro_wilk(
    df: DataFrame, features: Sequence[str], label: str | None = None, blocks: Blocks | None = None,
    p_value: bool = True,
) -> DataFrame:
    """Shapiro-Wilk W over all rows, per feature (and class), for groups of 3 rows or more.

    The weight of a value is a function of its rank and the group size alone, so W needs one
    blocked rank and one aggregate and no sample. The weights of a group add up to 0, so values
    need no centring. The p-value is Royston's approximation, calibrated up to 5000 rows.
    """
    keep = [label] if label else []
    keys = [*keep, "feature"]
    ranked = row_index(long_values(df, features, keep), keys, ["value"], "_i", blocks, total="n").where("n >= 3")
    i, n, x = F.col("_i") + 1, F.col("n").cast("double"), F.col("value")
    m = normal_quantile((i - 0.375) / (n + 0.25))
    outer = (i == 1) | (i == n)
    second = (n > 5) & ((i == 2) | (i == n - 1))
    inner = ~(outer | second)
    sums = ranked.groupBy(*map(column, keys)).agg(
        F.max("n").alias("n"),
        F.var_pop("value").alias("_var"),
        F.sum(m * m).alias("_mm"),
        F.sum(F.when(inner, m * m).otherwise(0.0)).alias("_inner_mm"),
        F.sum(F.when(inner, m * x).otherwise(0.0)).alias("_inner"),
        F.sum(F.when(outer, F.signum(m) * x).otherwise(0.0)).alias("_outer"),
        F.sum(F.when(second, F.signum(m) * x).otherwise(0.0)).alias("_second"),
        F.max(m).alias("_m1"),
        F.max(F.when(second, m)).alias("_m2"),
    )
    u = F.lit(1.0) / F.sqrt(F.col("n").cast("double"))
    first = F.when(F.col("n") == 3, F.sqrt(F.lit(0.5))).otherwise(
        F.col("_m1") / F.sqrt(F.col("_mm")) + _polynomial(OUTER_WEIGHT, u)
    )
    next_ = F.when(F.col("n") > 5, F.col("_m2") / F.sqrt(F.col("_mm")) + _polynomial(SECOND_WEIGHT, u)).otherwise(0.0)
    scale = F.sqrt(ratio(F.col("_inner_mm"), F.lit(1.0) - (first * first + next_ * next_) * 2))
    middle = F.when(F.col("n") > 3, ratio(F.col("_inner"), scale)).otherwise(0.0)
    top = middle + first * F.col("_outer") + next_ * F.col("_second")
    w = ratio(top * top, F.col("_var") * F.col("n"))
    tested = sums.select(*map(column, keys), "n", w.alias("w"))
    if p_value:
        tested = tested.withColumn("p_value", tails.on_results(tails.shapiro_upper, F.col("w"), F.col("n")))
    return tested
