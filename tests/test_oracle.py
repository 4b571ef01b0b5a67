"""Every query with SQL gives the same types and values on DuckDB."""

import pytest

import __spark_entry__ as entry_point
from compare import differences
from conftest import TESTDATA

from ebbtide.suite import oracle
from ebbtide.suite import queries as suite

SF = str(TESTDATA / "sf0.01")
# The optional queries have tests of their own in tests/llm.
QUERIES, SQL = suite.QUERIES, oracle.ORACLE
# Results of fits and sketches; compared with brute force in test_scoring and test_churn.
WITHOUT_SQL = {"fit_churn_model_terms", "score_risk", "auc_model_value", "gap_quantiles_sketched"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert differences(spark, SF, QUERIES[name], SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) | WITHOUT_SQL and not set(SQL) & WITHOUT_SQL


def test_entry_offers_every_query():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(SQL) <= set(entry_point.oracle_sql())


def test_entry_gives_rows(spark):
    assert entry_point.entry(spark).count() > 0
