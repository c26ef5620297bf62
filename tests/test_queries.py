"""Every registered query beside its SQL on the smallest tables; those without SQL have rows and a stable schema."""

import pytest
import side_by_side

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return side_by_side.connect(ROOT)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        df = entry.queries()[name](spark, ROOT)
        assert df.columns and df.count() >= 0
        return
    _, more, less = side_by_side.difference(spark, con, entry.queries()[name], sql, ROOT)
    assert not more and not less


def test_entry_is_stable(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() > 0


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
