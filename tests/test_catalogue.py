import pytest

from tallyquill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(name, compare, tiny):
    compare(name, catalogue.QUERIES[name], catalogue.ORACLES[name], tiny)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(name, spark, tiny):
    assert catalogue.QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"id", "correct_count", "total_turns", "first_correct", "last_correct", "accuracy"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
