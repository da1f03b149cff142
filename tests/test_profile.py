import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from conftest import rows
from riskflow.operators import comoments, correlation, profile


def people(spark):
    return spark.createDataFrame(
        [
            (25, 50000.0, "Sales", "Good worker"),
            (30, 60000.0, "IT", "Excellent"),
            (35, 75000.0, "HR", "Average"),
            (40, 80000.0, "Sales", "Excellent"),
            (45, 95000.0, "IT", "Good"),
        ],
        "age bigint, salary double, department string, notes string",
    )


def test_column_profile_kinds(spark):
    found = {r["name"]: r for r in profile.column_profile(people(spark)).collect()}
    assert found["age"]["kind"] == "numeric" and found["age"]["mean"] == 35.0
    assert abs(found["age"]["std"] - 7.905694150420948) < 1e-12
    assert found["salary"]["mean"] == 72000.0
    assert found["department"]["categories"] == ["HR", "IT", "Sales"]
    assert len(found["notes"]["categories"]) == 4


def test_threshold_is_exclusive(spark):
    kinds = lambda n: {r["name"]: r["kind"] for r in profile.column_profile(people(spark), n).collect()}
    assert kinds(5)["notes"] == "categorical"
    assert kinds(4)["notes"] == "free_text"
    assert kinds(4)["department"] == "categorical"


def test_profile_edge_columns(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (CAST(NULL AS STRING), true, CAST('NaN' AS DOUBLE), DATE'2024-01-01'), "
        "(NULL, false, 2.0, DATE'2024-01-02') AS t(empty, flag, x, d)"
    )
    found = {r["name"]: r for r in profile.column_profile(df).collect()}
    assert found["empty"]["kind"] == "categorical" and found["empty"]["categories"] == []
    assert found["flag"]["kind"] == "numeric" and found["flag"]["mean"] == 0.5
    assert found["x"]["mean"] == 2.0 and found["x"]["std"] is None
    assert found["d"]["kind"] == "free_text"


def test_near_threshold_is_decided_exactly(spark):
    df = spark.range(3000).select((F.col("id") % 1000).cast("string").alias("a"), (F.col("id") % 999).cast("string").alias("b"))
    kinds = {r["name"]: r["kind"] for r in profile.column_profile(df).collect()}
    assert kinds == {"a": "free_text", "b": "categorical"}


def test_missingness_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, None), (2.0, "b")], "x double, s string")
    assert rows(profile.missingness(df)) == [("s", 2, 50.0), ("x", 2, 50.0)]
    assert {r[0]: r[1] for r in rows(profile.non_null_counts(df))} == {"x": 2, "s": 2}


def test_value_counts_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    assert [tuple(r) for r in profile.value_counts(df, "v").collect()] == [("c", 2), ("a", 1), ("b", 1)]


def test_target_distribution_weighs_nulls_in_the_total(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (None,)], "t int")
    assert rows(profile.target_distribution(df, "t")) == [(0, 2, 50.0), (1, 1, 25.0)]


def test_group_counts_drop_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("a", 1)], "c string, t int")
    assert rows(profile.group_counts(df, ["c", "t"])) == [("a", 1, 2)]


def test_describe_matches_hand_computed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    r = profile.describe_numeric(df).first()
    assert tuple(r) == ("x", 4, 4.0, r["std"], 1.0, 1.75, 2.5, 4.75, 10.0)
    assert abs(r["std"] - math.sqrt(50 / 3)) < 1e-12


def test_pearson_is_pairwise_complete_and_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, None, 7.0), (4.0, 8.0, 7.0)], "a double, b double, c double")
    found = {(r[0], r[1]): r[2] for r in correlation.pearson_matrix(df, ["a", "b", "c"]).collect()}
    assert abs(found["a", "b"] - 1.0) < 1e-12
    assert found["a", "c"] is None


def test_blocks_merge_to_the_whole(spark, monkeypatch, tables):
    names = ["l_quantity", "l_discount", "l_tax"]
    lines = tables("lineitem")
    whole = rows(correlation.pearson_matrix(lines, names))
    monkeypatch.setattr(comoments, "FAN_IN", 2)
    parts = rows(correlation.pearson_matrix(lines.repartition(11), names))
    assert [(a, b, round(r, 9)) for a, b, r in parts] == [(a, b, round(r, 9)) for a, b, r in whole]


def test_comoments_keep_their_digits_far_from_zero(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") % 10 + 1e9).alias("a"), (F.col("id") % 10 * 3 - 1e9).alias("b"), F.lit(1e9 + 0.1).alias("c"))
    found = {(r[0], r[1]): r[2] for r in correlation.pearson_matrix(df, ["a", "b", "c"]).collect()}
    assert abs(found["a", "b"] - 1) < 1e-9 and found["a", "c"] is None and found["c", "c"] is None


def test_correlations_of_random_tables_with_holes(spark):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 6, (300, 5)).astype(float)
    data[:, 3] = data[:, 0] * 2 + rng.normal(size=300)
    data[rng.random((300, 5)) < [0.3, 0.0, 0.5, 0.1, 0.0]] = np.nan
    frame = pd.DataFrame(data, columns=list("abcde"))
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in data], "a double, b double, c double, d double, e double").repartition(3)
    for found, method in ((correlation.pearson_matrix(df, list("abcde")), "pearson"), (correlation.spearman_matrix(df, list("abcde")), "spearman")):
        got = {(r[0], r[1]): r[2] for r in found.collect()}
        assert len(got) == 15
        for (a, b), r in got.items():
            both = frame[[a, b]].dropna() if a != b else frame[[a]].dropna().assign(_=frame[a])
            ranked = both.rank() if method == "spearman" else both
            assert r == pytest.approx(np.corrcoef(ranked.iloc[:, 0], ranked.iloc[:, 1])[0, 1], abs=1e-9)
    top = correlation.target_correlation(df, "e", list("abcd")).collect()
    assert [r["correlation"] for r in top] == sorted((r["correlation"] for r in top), reverse=True) and len(top) == 4


def test_number_of_jobs_does_not_depend_on_columns(spark):
    def jobs(names, method):
        df = spark.range(200).select(*(F.when(F.col("id") % (i + 2) > 0, F.hash("id", F.lit(i))).alias(c) for i, c in enumerate(names)))
        spark.sparkContext.setJobGroup(f"{method.__name__}-{len(names)}", "")
        method(df, names).collect()
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(f"{method.__name__}-{len(names)}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(found)

    for method in (correlation.pearson_matrix, correlation.spearman_matrix):
        assert abs(jobs(list("abc"), method) - jobs([f"c{i}" for i in range(12)], method)) <= 3


def test_spearman_on_the_range_path(tables):
    names = ["l_quantity", "l_extendedprice"]
    whole = rows(correlation.spearman_matrix(tables("lineitem"), names))
    other = rows(correlation.spearman_matrix(tables("lineitem"), names, single_task_rows=10))
    assert [(a, b, round(r, 9)) for a, b, r in other] == [(a, b, round(r, 9)) for a, b, r in whole]


def test_spearman_moves_rows_only_for_columns_too_wide_to_broadcast(spark, tables, monkeypatch):
    names, moved = ["l_quantity", "l_extendedprice", "l_discount"], []
    original = correlation.paired_comoments

    def seen(matrices, *rest):
        moved.append(matrices._jdf.queryExecution().executedPlan().toString())
        return original(matrices, *rest)

    monkeypatch.setattr(correlation, "paired_comoments", seen)
    whole = rows(correlation.spearman_matrix(tables("lineitem"), names))
    assert "SortMergeJoin" not in moved[0] and "Exchange hashpartitioning" not in moved[0]
    monkeypatch.setattr(correlation, "BROADCAST_ROWS", 1000)
    apart = rows(correlation.spearman_matrix(tables("lineitem"), names))
    assert moved[1].count("SortMergeJoin") == 1
    assert [r[2] for r in apart] == pytest.approx([r[2] for r in whole])


def test_spearman_pair_with_nulls(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, None), (None, 2.0), (5.0, 3.0)], "a double, b double")
    assert abs(correlation.spearman(df, "a", "b").first()["correlation"] - 0.5) < 1e-12
