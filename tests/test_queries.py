import pytest
from sqlcheck import check_db, compare

from segspark import plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.load()


@pytest.fixture(scope="module")
def con():
    return check_db(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_check(spark, con, name):
    compare(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0
