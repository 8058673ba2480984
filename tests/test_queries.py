"""Every registered query against its SQL at the smallest scale."""

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from tests.compare import connect, differences

SLOW = {"random_search", "train_rf", "train_gbt", "score_rows"}


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_DIR)


def test_entry_has_rows(spark):
    frame = entry(spark)
    assert frame.count() == 1000
    # Known totals at this scale.
    assert frame.agg({"threat_score": "sum"}).first()[0] == 2937
    assert frame.where("label = 1").count() == 625


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert differences(queries()[name](spark, SMOKE_DIR), con, oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert queries()[name](spark, SMOKE_DIR).count() > 0
