import pytest

from lavra import queries as core
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, data, name):
    same(core.QUERIES[name](spark, data), connect(data), core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_runs(spark, data, name):
    df = core.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
