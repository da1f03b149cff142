"""Every registered query against its SQL, and the entry points."""

import pytest

import __spark_entry__ as entry_points
import oracle

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def connection(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, folder, connection, name):
    assert oracle.differences(QUERIES[name](spark, folder), ORACLES[name], connection) == []


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_comparison_notices_differences(spark, connection):
    same = spark.sql("SELECT CAST(1 AS BIGINT) AS a, 'x' AS b")
    assert oracle.differences(same, "SELECT 1::bigint AS a, 'x' AS b", connection) == []
    assert oracle.differences(same, "SELECT 2::bigint AS a, 'x' AS b", connection)
    assert oracle.differences(same, "SELECT 1::int AS a, 'x' AS b", connection)
    assert oracle.differences(same, "SELECT 1::bigint AS a, 'x' AS c", connection)
    assert oracle.differences(same, "SELECT 1::bigint AS a, 'x' AS b WHERE false", connection)
