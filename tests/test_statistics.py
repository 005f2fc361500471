"""Tails against published values and identities; tests against direct computation."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessiongrid.functions import tails
from sessiongrid.operators import hypothesis as h
from sessiongrid.operators import metrics
from sessiongrid.operators.ordered import Blocks
from sessiongrid.plans import significance


def test_tails_against_tables():
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, rel=1e-5)
    assert tails.t_two_sided(12.7062047, 1) == pytest.approx(0.05, rel=1e-6)
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.chi2_upper(3.841459, 1) == pytest.approx(0.05, rel=1e-5)
    assert tails.chi2_upper(0.0, 3) == 1.0
    assert tails.f_upper(4.102821, 2, 10) == pytest.approx(0.05, rel=1e-5)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, rel=1e-5)
    assert tails.studentized_range_upper(3.88, 3, 10) == pytest.approx(0.05, abs=3e-4)
    assert tails.studentized_range_upper(3.577935, 3, 20) == pytest.approx(0.05, rel=1e-5)
    assert tails.studentized_range_upper(3.31449, 3, 1e9) == pytest.approx(0.05, rel=1e-3)


def test_tail_identities_and_deep_tails():
    for t, df in [(0.3, 4), (2.5, 7.7), (17.0, 28000)]:
        assert tails.f_upper(t * t, 1, df) == pytest.approx(tails.t_two_sided(t, df), rel=1e-9)
        assert tails.studentized_range_upper(t * math.sqrt(2), 2, df) == pytest.approx(tails.t_two_sided(t, df), rel=1e-4, abs=1e-9)
    assert tails.chi2_upper(1000.0, 2) == pytest.approx(math.exp(-500), rel=1e-9)
    assert 0 < tails.t_two_sided(17.0, 28000) < 1e-60
    assert tails.chi2_upper(20.0, 10) == pytest.approx(sum(math.exp(-10) * 10**i / math.factorial(i) for i in range(5)), rel=1e-12)


def test_tails_of_missing_values():
    assert math.isnan(tails.t_two_sided(math.nan, 3)) and math.isnan(tails.chi2_upper(math.nan, 3))
    assert math.isnan(tails.studentized_range_upper(math.nan, 3, 9))


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(5)
    data = [(c, r.gauss(c / 4, 1 + c / 5), float(r.randint(0, 4) + c), 7.0, r.choice([None, r.random()])) for c in (0, 1, 2) for _ in range(30 + 9 * c)]
    return spark.createDataFrame(data, "y int, a double, b double, flat double, holes double").cache()


def groups(table, feature):
    found = {}
    for r in table.collect():
        if r[feature] is not None:
            found.setdefault(r.y, []).append(r[feature])
    return {k: np.array(v) for k, v in found.items()}


def ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_welch(table):
    got = {r.feature: r for r in h.welch_t(table, ["a", "b", "flat", "holes"], "y").collect()}
    for f in ("a", "b", "holes"):
        x, y = (groups(table, f)[c] for c in (0, 1))
        vx, vy = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
        assert got[f].t == pytest.approx((x.mean() - y.mean()) / math.sqrt(vx + vy))
        assert got[f].df == pytest.approx((vx + vy) ** 2 / (vx**2 / (len(x) - 1) + vy**2 / (len(y) - 1)))
        assert 0 < got[f].p_value <= 1
    assert got["flat"].t is None


@pytest.mark.parametrize("blocks", [Blocks(), Blocks((0.5, 1.0, 2.0, 3.0))])
def test_kruskal_and_dunn(table, blocks):
    sums = h.rank_sums(table, ["a", "b", "flat", "holes"], "y", [0, 1, 2], blocks)
    got = {r.feature: r for r in h.kruskal_h(sums, 3).collect()}
    pairs = {(r.feature, r.class_a, r.class_b): r for r in h.dunn(sums, [0, 1, 2]).collect()}
    for f in ("a", "b", "holes"):
        g = groups(table, f)
        x = np.concatenate([g[c] for c in (0, 1, 2)])
        rk, n = ranks(x), len(x)
        parts = np.split(rk, np.cumsum([len(g[0]), len(g[1])]))
        ties = sum(t**3 - t for t in np.unique(x, return_counts=True)[1].astype(float))
        raw = 12 / (n * (n + 1)) * sum(p.sum() ** 2 / len(p) for p in parts) - 3 * (n + 1)
        assert got[f].h == pytest.approx(raw / (1 - ties / (n**3 - n)))
        spread = n * (n + 1) / 12 - ties / (12 * (n - 1))
        for a, b in ((0, 1), (0, 2), (1, 2)):
            z = (parts[a].mean() - parts[b].mean()) / math.sqrt(spread * (1 / len(parts[a]) + 1 / len(parts[b])))
            assert pairs[f, a, b].z == pytest.approx(z)
            assert pairs[f, a, b].p_value == pytest.approx(min(1, 3 * 2 * (1 - NormalDist().cdf(abs(z)))), abs=1e-9)
    assert got["flat"].h is None


def test_anova_and_tukey(table):
    classes = h.class_table(h.class_moments(table, ["a", "b", "flat"], "y"), [0, 1, 2])
    got = {r.feature: r for r in h.anova_f(classes).collect()}
    for f in ("a", "b"):
        g = groups(table, f)
        every = np.concatenate(list(g.values()))
        within = sum(((x - x.mean()) ** 2).sum() for x in g.values()) / (len(every) - 3)
        between = sum(len(x) * (x.mean() - every.mean()) ** 2 for x in g.values()) / 2
        assert got[f].f == pytest.approx(between / within)
        assert got[f].p_value == pytest.approx(tails.f_upper(between / within, 2, len(every) - 3))
    pairs = h.tukey_hsd(classes, [0, 1, 2]).where("feature = 'a'").collect()
    assert len(pairs) == 3 and all(0 <= r.p_value <= 1 for r in pairs)
    assert got["flat"].f is None


def test_two_class_tests_agree(table):
    """F of two classes is the square of the pooled t, so Tukey and ANOVA give one p-value."""
    two = table.where("y < 2")
    classes = h.class_table(h.class_moments(two, ["a"], "y"), [0, 1])
    p = h.anova_f(classes).first().p_value
    assert h.tukey_hsd(classes, [0, 1]).first().p_value == pytest.approx(p, rel=1e-3)


# Published example: fuel economy of 32 cars, W = 0.94756, p = 0.1229.
CARS = [21, 21, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4,
        33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26, 30.4, 15.8, 19.7, 15, 21.4]
# Published example: weights of 11 men, W = 0.79, p = 0.0067.
MEN = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


@pytest.mark.parametrize("blocks", [Blocks(), Blocks((15.0, 20.0, 160.0, 180.0))])
def test_shapiro(spark, blocks):
    rows = [("cars", float(v)) for v in CARS] + [("men", float(v)) for v in MEN] + [("three", 1.0), ("three", 2.0), ("three", 9.0)]
    got = {r.g: r for r in h.shapiro_wilk(spark.createDataFrame(rows, "g string, v double"), ["v"], "g", blocks).collect()}
    assert got["cars"].w == pytest.approx(0.94756, abs=2e-5) and got["cars"].p_value == pytest.approx(0.1229, abs=2e-4)
    assert got["men"].w == pytest.approx(0.79, abs=5e-3) and got["men"].p_value == pytest.approx(0.0067, abs=2e-4)
    assert got["three"].w == pytest.approx(0.5 * 64 / 38)


def test_normal_quantile(spark):
    ps = [1e-12, 1e-5, 0.01, 0.2, 0.5, 0.7, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", h.normal_quantile(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-6, abs=1e-6)


def test_anova_then_tukey(table):
    anova, pairs = significance.anova_tukey(table, ["a", "b", "flat"], "y")
    chosen = {r.feature for r in anova.collect() if r.p_value is not None and r.p_value * 3 < 0.05}
    assert chosen and {r.feature for r in pairs.collect()} == chosen


def test_starred_table(table):
    found = significance.kruskal_table(table, ["a", "b", "flat"], "y", drop=(9,)).collect()
    assert found and {"dunn_0_1", "dunn_0_2", "dunn_1_2"} <= set(found[0].asDict())


def test_bonferroni_is_not_clipped(spark):
    df = spark.createDataFrame([(0.4,)], "p double")
    assert df.select(h.bonferroni(F.col("p"), 5)).first()[0] == pytest.approx(2.0)
    assert df.select(h.bonferroni(F.col("p"), 5, True)).first()[0] == 1.0


def test_metrics_with_missing_classes(spark):
    """Class 2 is never predicted, class 3 never true."""
    rows = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 3), (1, 0)]
    counts = metrics.confusion(spark.createDataFrame(rows, "y int, yhat int"), "y", "yhat")
    got = {r["class"]: r for r in metrics.class_report(counts).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert (got[2].precision, got[2].recall, got[2].f1, got[2].support) == (0.0, 0.0, 0.0, 2)
    assert (got[3].precision, got[3].recall, got[3].support) == (0.0, 0.0, 0)
    macro = metrics.macro_metrics(counts).first()
    assert macro.accuracy == pytest.approx(2 / 6)
    assert macro.precision == pytest.approx((1 / 2 + 1 / 3) / 4) and macro.recall == pytest.approx((1 / 2 + 1 / 2) / 4)


def test_auc(spark):
    r = random.Random(6)
    rows = [(r.randint(0, 1), float(r.randint(0, 9))) for _ in range(80)]
    df = spark.createDataFrame(rows, "y int, s double")
    ones, zeros = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    for blocks in (Blocks(), Blocks((2.0, 5.0))):
        assert metrics.area_under_roc(df, "y", "s", blocks=blocks).first().auc == pytest.approx(want)
    assert metrics.area_under_roc(df.where("y = 1"), "y", "s").first().auc is None
