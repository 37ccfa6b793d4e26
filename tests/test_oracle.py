import pytest

from palim.plans import catalogue
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_all_queries_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_consolidation_fold(spark, sf_dir):
    """Every fact is still there, and what is new has its episode as its source."""
    rows = catalogue.QUERIES["consolidate_apply"](spark, sf_dir)
    assert rows.count() > 0
    assert rows.filter("id LIKE 'e%/%' AND source_count < 1").count() == 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
