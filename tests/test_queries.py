"""Every registered query of the core against its SQL over whole tables; those without SQL must run."""

import pytest

from docloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, compare, spark, data):
    if name in SQL:
        compare(QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, data).count() > 0  # their results are held against literals in test_functions.py


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
