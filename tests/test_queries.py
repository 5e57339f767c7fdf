"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import database, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, con, name):
    spark.catalog.clearCache()
    frame = QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    cursor = con.execute(CHECKS[name])
    want = cursor.fetchall()
    assert difference(frame.columns, rows, [d[0] for d in cursor.description], want) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_gives_rows(spark, name):
    spark.catalog.clearCache()
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns and frame.count() >= 1


def test_names_and_checks_belong_together():
    assert set(CHECKS) <= set(QUERIES)
