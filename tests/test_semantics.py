"""Cases that the shared tables do not hold: NaN, unknown targets, many classes, scores that are no numbers."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from riskflow.functions.scalars import value_text
from riskflow.operators import categorical, correlation, metrics, profile, sampling
from riskflow.operators.tuning import RandomSearch

NAN = float("nan")


@pytest.fixture(scope="module")
def holed(spark):
    return spark.createDataFrame([(1, NAN), (2, 2.0), (3, None), (4, 321.0), (5, 2.5), (6, 2.0)], "id int, x double")


def test_nan_is_no_value(holed):
    assert rows(profile.value_counts(holed, "x")) == [(2.0, 2), (2.5, 1), (321.0, 1)]
    assert profile.distinct_counts(holed, ["x"]).first()["distinct_count"] == 3
    assert rows(profile.distinct_values(holed, "x")) == [(2.0,), (2.5,), (321.0,)]


def test_numbers_have_one_spelling(holed):
    texts = [r["t"] for r in holed.select(value_text(holed.schema["x"]).alias("t"), "id").orderBy("id").collect()]
    assert texts == ["nan", "2", "nan", "321", "2.5", "2"]
    tokens = {r["token"] for r in categorical.fit_vocabulary(holed, ["x"]).collect()}
    assert tokens == {"2", "321", "2.5"}
    values = {r["value"]: r["count"] for r in categorical.fit_category_mapping(holed, ["x"]).collect()}
    assert values == {"nan": 2, "2": 2, "321": 1, "2.5": 1}


def test_long_texts_are_counted_once(spark):
    df = spark.createDataFrame([("a" * 100,), ("a" * 100,), ("a" * 101,), ("b",)], "t string")
    assert profile.distinct_counts(df, ["t"]).first()["distinct_count"] == 3


def test_spearman_ranks_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, None), (4.0, 4.0), (5.0, 3.0), (NAN, 9.0)], "a double, b double")
    found = {(r[0], r[1]): r[2] for r in correlation.spearman_matrix(df, ["a", "b"]).collect()}
    assert found[("a", "b")] == pytest.approx(correlation.spearman(df, "a", "b").first()["correlation"])
    assert found[("a", "b")] == pytest.approx(0.6) and found[("a", "a")] == pytest.approx(1.0)


def test_unknown_targets_take_no_part(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (-1, 1), (None, 0)], "y int, h int")
    assert metrics.accuracy(df, "y", "h").first()["accuracy"] == 1.0
    report = {r["label"]: r for r in metrics.classification_report(df, "y", "h").collect()}
    assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"} and report["macro avg"]["f1_score"] == 1.0


def test_a_class_named_like_a_summary(spark):
    df = spark.createDataFrame([("accuracy", "accuracy"), ("x", "accuracy")], "y string, h string")
    report = metrics.classification_report(df, "y", "h").collect()
    assert sorted(r["label"] for r in report).count("accuracy") == 2
    assert len(report) == 5


def test_many_classes_are_weighted(spark):
    df = spark.range(1800).select((F.col("id") % 900).alias("y"))
    weighted = sampling.with_class_weights(df, "y")
    assert weighted.where("abs(weight - 1) > 1e-12").isEmpty() and weighted.count() == 1800


def test_a_score_that_is_no_number_is_a_failed_trial(spark):
    search = RandomSearch(trials=4, seed=1)
    found = []

    def objective(params):
        found.append(params["a"])
        return NAN if len(found) % 2 else params["a"]

    best = search.optimize(objective, {"a": lambda rng: rng.uniform(0, 1)})
    assert best[1] == max(found[1], found[3]) and not math.isnan(best[1])
    assert rows(search.trials_table().groupBy("state").count()) == [("complete", 2), ("failed", 2)]
