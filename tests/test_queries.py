import pytest

from roamspark.plans import queries as q

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(agree, name):
    agree(q.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert q.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
