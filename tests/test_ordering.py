"""Running totals: the range path must equal the single-window path and brute force."""

from pyspark.sql import functions as F

from conftest import rows
from riskflow.operators import profile
from riskflow.operators.ordering import average_ranks, row_positions, running_total


def test_range_path_equals_window_path(tables):
    orders = tables("orders")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    amounts = {"total": F.col("o_custkey"), "position": F.lit(1)}
    small = running_total(orders, ["o_orderstatus"], order, amounts)
    ranged = running_total(orders, ["o_orderstatus"], order, amounts, single_task_rows=10)
    assert rows(small, "o_orderkey", "total", "position") == rows(ranged, "o_orderkey", "total", "position")


def test_many_ranges(tables, monkeypatch):
    monkeypatch.setattr("riskflow.operators.ordering.ROWS_PER_RANGE", 37)
    orders = tables("orders")
    out = row_positions(orders, [], [F.col("o_orderkey")], "position", single_task_rows=1)
    assert [p for _, p in rows(out, "o_orderkey", "position")] == list(range(1, orders.count() + 1))


def test_rows_equal_in_order_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr("riskflow.operators.ordering.ROWS_PER_RANGE", 100)
    df = spark.range(1000).select(F.when(F.col("id") < 700, 5).otherwise(F.col("id")).alias("x"), F.lit("g").alias("g"))
    out = row_positions(df, ["g"], [F.col("x")], "position", single_task_rows=1)
    assert sorted(p for (p,) in rows(out, "position")) == list(range(1, 1001))
    assert max(p for x, p in rows(out, "x", "position") if x == 5) == 700


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, x int")
    assert row_positions(df, ["g"], [F.col("x")], "position").count() == 0


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (2.0,)], "x double")
    ranks = rows(average_ranks(df, {"x": F.col("x")}), "value", "average_rank")
    assert ranks == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5)]


def test_quantiles_on_the_range_path(tables):
    orders = tables("orders")
    a = profile.exact_quantiles(orders, ["o_totalprice"], (0.1, 0.5, 0.99))
    b = profile.exact_quantiles(orders, ["o_totalprice"], (0.1, 0.5, 0.99), single_task_rows=10)
    expected = orders.selectExpr("percentile(o_totalprice, array(0.1, 0.5, 0.99)) AS p").first()["p"]
    assert rows(a) == rows(b)
    assert all(abs(x - y) < 1e-6 for x, y in zip(a.first()[1:], expected, strict=True))
