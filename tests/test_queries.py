"""Every registered query with SQL against DuckDB, and the plan shape of the large steps."""

import pytest
from compare_sql import canonical, duck

import __spark_entry__ as entry
from portrisk.catalog import queries as catalog

SQL = entry.oracle_sql()
NEED_MODEL = {"shap_additivity", "monotonicity_audit"}


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_registry():
    names = set(entry.queries())
    assert set(SQL) <= names and len(names) >= 50


@pytest.mark.parametrize("name", [n for n in SQL if n not in NEED_MODEL])
def test_query_matches_sql(spark, folder, con, name):
    got, want = entry.queries()[name](spark, folder).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["client_features", "drift_ks", "roc_auc", "stratified_split", "asset_bounds", "market_cov"])
def test_no_cartesian_product(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark, folder):
    text = plan(catalog.client_features(spark, folder))
    assert "l_comment" not in text and "o_orderpriority" not in text and "l_tax" not in text


def test_flag_filter_sits_below_the_solver(spark, folder):
    text = plan(catalog.optimize_portfolios(spark, folder))
    solver = text.index("ArrowEvalPython")
    assert "0.5" in text[solver:] and "Filter" in text[solver:]
