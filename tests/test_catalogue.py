import pytest
from oracle import compare, connect
from trialframe.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, data_dir, con, name):
    compare(QUERIES[name](spark, data_dir), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0
