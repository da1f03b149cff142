import pytest
from pyspark.sql import functions as F

from conftest import rows
from riskflow.functions.hashing import hash_fraction
from riskflow.operators import sampling


def test_fraction_ignores_the_partitioning(spark):
    ids = spark.range(5000)
    a = rows(ids.repartition(3), "id", hash_fraction("id", 42))
    b = rows(ids.repartition(17), "id", hash_fraction("id", 42))
    assert a == b
    assert all(0 <= f < 1 for _, f in a)
    assert sum(f for _, f in a) / 5000 == pytest.approx(0.5, abs=0.02)
    assert a != rows(ids, "id", hash_fraction("id", 43))


def test_split_and_holdout_shares(spark):
    ids = spark.range(10000)
    assert sampling.split_rows(ids, "id").where("set = 'train'").count() == pytest.approx(8000, abs=150)
    assert ids.where(sampling.is_holdout("id", 0.2)).count() == pytest.approx(2000, abs=150)
    assert [sampling.holdout_period(f) for f in (0.9, 0.5, 0.3, 0.2, 0.15, 0.1)] == [2, 2, 3, 5, 7, 10]


@pytest.mark.parametrize("fraction", [0.0, 1.0, -1.0, 2.0])
def test_fraction_range(spark, fraction):
    with pytest.raises(ValueError):
        sampling.split_rows(spark.range(1), "id", fraction)
    with pytest.raises(ValueError):
        sampling.is_holdout("id", fraction)


def test_undersampling_balances(spark):
    df = spark.range(10000).withColumn("t", (F.col("id") % 10 == 0).cast("int"))
    counts = dict(rows(sampling.undersample_negatives(df, "t", "id").groupBy("t").count()))
    assert counts[1] == 1000 and counts[0] == pytest.approx(1000, abs=120)


def test_undersampling_with_more_positives_keeps_all_and_drops_unknown(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([1, 1, 1, 0, -1])], "id int, t int")
    assert sampling.undersample_negatives(df, "t", "id").count() == 4
    only = df.where("t = 1")
    assert sampling.undersample_negatives(only, "t", "id").count() == 3


@pytest.mark.parametrize("limit", [10**6, 10])
def test_folds_are_stratified(spark, limit):
    df = spark.range(1003).withColumn("t", (F.col("id") % 7 == 0).cast("int"))
    folds = sampling.stratified_folds(df, "t", "id", 5, single_task_rows=limit)
    assert folds.count() == 1003 and folds.columns == ["id", "t", "fold"]
    sizes = rows(folds.groupBy("t", "fold").count())
    for t in (0, 1):
        of = [n for label, _, n in sizes if label == t]
        assert len(of) == 5 and max(of) - min(of) <= 1


def test_fold_paths_agree(spark):
    df = spark.range(500).withColumn("t", (F.col("id") % 3 == 0).cast("int"))
    assert rows(sampling.stratified_folds(df, "t", "id")) == rows(sampling.stratified_folds(df, "t", "id", single_task_rows=5))


def test_folds_with_a_key_held_by_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr("riskflow.operators.ordering.ROWS_PER_RANGE", 50)
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit(1).alias("t"), "id")
    sizes = [n for _, n in rows(sampling.stratified_folds(df, "t", "k", 5, single_task_rows=5).groupBy("fold").count())]
    assert sizes == [180] * 5


@pytest.mark.parametrize("hot", [10**6, 20])
def test_folds_past_the_bound_move_rows_once_unless_a_key_is_frequent(spark, monkeypatch, hot):
    monkeypatch.setattr(sampling, "HOT_ROWS", hot)
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("t"), F.when(F.col("id") < 700, -1).otherwise(F.col("id")).alias("k"))
    found = sampling.stratified_folds(df, "t", "k", 5, single_task_rows=100)
    few = sampling.stratified_folds(df, "t", "k", 5)
    single = "k >= 0"  # rows of one key are alike
    assert rows(found.where(single)) == rows(few.where(single))
    assert rows(found.groupBy("t", "fold").count()) == rows(few.groupBy("t", "fold").count())
    if hot > 2000:
        moved = found._jdf.queryExecution().executedPlan().toString()
        assert moved.count("Exchange hashpartitioning(t") == 1 and "SortMergeJoin" not in moved and "rangepartitioning" not in moved


def test_folds_past_the_bound_keep_rows_without_a_label(spark):
    df = spark.range(600).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("t"))
    assert rows(sampling.stratified_folds(df, "t", "id", single_task_rows=50)) == rows(sampling.stratified_folds(df, "t", "id"))


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(None,)], "t int")
    assert rows(sampling.class_weights(df, "t"), "label", "weight") == [(0, pytest.approx(8 / 12)), (1, 2.0)]
    assert sorted({w or 0.0 for _, w in rows(sampling.with_class_weights(df, "t"))}) == pytest.approx([0.0, 8 / 12, 2.0])


def test_shuffle_is_seeded_and_planned_as_top_k(tables):
    orders = tables("orders")
    first = sampling.shuffled(orders, "o_orderkey").limit(5)
    assert "TakeOrderedAndProject" in first._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in first.collect()] == [r[0] for r in sampling.shuffled(orders.repartition(7), "o_orderkey").limit(5).collect()]
    assert [r[0] for r in first.collect()] != [r[0] for r in sampling.shuffled(orders, "o_orderkey", 1).limit(5).collect()]


def test_cohort(spark):
    parents = spark.range(1000).withColumnRenamed("id", "k")
    children = spark.range(3000).select((F.col("id") % 1500).alias("k"), "id")
    chosen, matching = sampling.sample_cohort(parents, children, "k", 0.1)
    keys = {r[0] for r in chosen.collect()}
    assert 0 < len(keys) < 200
    assert matching.count() == 2 * len(keys)
