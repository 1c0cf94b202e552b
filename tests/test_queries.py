import pytest

from barloom.plans import catalog
from tests.oracle import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert rows_of(catalog.QUERIES[name](spark, sf)) == rows_of_sql(catalog.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_do_not_depend_on_partitions(spark, sf, name):
    """Queries without SQL; slow models and hand-made cases of their operators are in test_operators."""
    first = rows_of(catalog.QUERIES[name](spark, sf))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows_of(catalog.QUERIES[name](spark, sf)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
