import pytest
from oracle import DATA, connect, same

from siltworks.plans import problems, reference

QUERIES, SQL = problems.QUERIES | reference.QUERIES, problems.SQL | reference.SQL


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        same(df, SQL[name], duck)
    else:
        df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
