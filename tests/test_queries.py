"""Every registered query at the smallest scale, beside its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from propense.plans.check import compare, connect


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(name, spark, sf_dir, connection):
    assert compare(spark, connection, entry.queries()[name], entry.oracle_sql()[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(name, spark, sf_dir):
    result = entry.queries()[name](spark, sf_dir)
    assert len(result.columns) == len(set(result.columns))
    # At the smallest scale nearly every user uses the target item, so this list may be empty.
    assert result.count() > 0 or name == "svd_potential_users"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "item_id", "prediction"]
