from pyspark.sql import functions as F
import pytest

from conftest import rows
from riskflow.operators.joins import left_join, lookup, semi_join, small_enough
from riskflow.session import materialise


def test_left_join_keeps_left_rows_and_left_columns(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "z", 9), (3, "y", 8)], "k int, v string, w int")
    out = left_join(left, right, "k")
    assert out.columns == ["k", "v", "w"]
    assert rows(out) == [(1, "a", 9), (2, "b", None)]


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_left_join_with_repeated_right_keys(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        left = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b"), (None, "n")], "k int, v string")
        right = spark.createDataFrame([(1, 9), (1, 8), (3, 7), (None, 6)], "k int, w int")
        for unique in (True, False):
            out = rows(left_join(left, right, "k", unique))
            assert out == [(None, "n", None), (1, "a", 8), (1, "a", 9), (1, "c", 8), (1, "c", 9), (2, "b", None)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_left_join_needs_the_key(spark):
    left = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError, match="right"):
        left_join(left, left.withColumnRenamed("k", "other"), "k")


def test_semi_join_does_not_repeat(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    kept = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert rows(semi_join(df, kept, "k")) == [(1,)]


@pytest.mark.parametrize("fits", [True, False, None])
@pytest.mark.parametrize("weight", ["count", None])
@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_lookup_paths_agree(spark, monkeypatch, fits, weight, hot):
    monkeypatch.setattr("riskflow.operators.joins.HOT_VALUES", hot)
    # One value holds a third of the rows, one is unknown and frequent, some are null.
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 5 == 0, "unseen")
    df = spark.range(600).withColumn("k", key.otherwise(F.concat(F.lit("v"), (F.col("id") % 50).cast("string"))))
    table = materialise(
        df.where("k <> 'unseen'").groupBy("k").agg(F.count("*").alias("count"), (F.max("id") * 10).alias("answer"))
    )
    expected = {r["k"]: r["answer"] for r in table.collect()}
    out = lookup(df, "k", table, "k", "answer", "got", F.lit(-1).cast("bigint"), weight, fits)
    assert out.columns == ["id", "k", "got"]
    assert out.count() == 600
    assert all(got == expected.get(k, -1) for _, k, got in out.collect())


def test_small_enough_measures_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, 1)], "k string, v int")
    assert small_enough(df)
    assert not small_enough(df, size=500)
    assert not small_enough(df, rows=0)
    assert small_enough(df.limit(0))


def test_shuffled_lookup_is_not_broadcast_whole(spark):
    df = spark.range(10).withColumn("k", F.col("id").cast("string"))
    table = materialise(df.select("k", F.lit(1).alias("answer")))
    plan = lookup(df, "k", table, "k", "answer", "got", F.lit(0), fits=False)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan
