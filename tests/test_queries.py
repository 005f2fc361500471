"""Every registered query against its SQL on the smallest tables, and the entry contract."""

import pytest

import __spark_entry__ as contract
from oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()
PLAIN = [
    "tukey_p", "kruskal_starred", "shapiro_wilk", "pca_k", "feature_importance", "late_fusion", "mlp",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    # a set difference or an exclusion may be empty in so small a table
    found = difference(contract.queries()[name](spark, SF_DIR), con, SQL[name])
    assert found in (None, "no rows")


@pytest.mark.parametrize("name", PLAIN)
def test_query_without_sql_runs(spark, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() >= (0 if name == "kruskal_starred" else 1)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and all(r.n_0 + r.n_1 == r.total for r in rows)
