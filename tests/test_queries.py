"""Every query against its SQL in DuckDB on the smallest tables."""

import pytest

from lotlens import plans

from .oracle import connect, of_spark, of_sql

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, PATH)
    if name in plans.SQL:
        assert of_spark(df) == of_sql(con, plans.SQL[name])
    else:
        assert df.count() > 0


def test_entry_point():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
