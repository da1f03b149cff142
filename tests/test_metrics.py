import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from riskflow.functions.losses import average_loss, check_loss, focal_terms
from riskflow.functions.scalars import bin_edges, equal_width_bin
from riskflow.operators import calibration, metrics

SCHEMA = "y int, p double"


def brute_auc(y, p):
    pos, neg = [s for s, t in zip(p, y) if t == 1], [s for s, t in zip(p, y) if t == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    y = (rng.random(400) < 0.3).astype(int)
    p = np.clip(np.round(0.4 * y + 0.6 * rng.random(400), 2), 0, 1)
    return y, p, spark.createDataFrame(pd.DataFrame({"y": y, "p": p}), SCHEMA)


@pytest.mark.parametrize("limit", [10**6, 5])
def test_auc_equals_pair_counting(scored, limit):
    y, p, df = scored
    assert metrics.roc_auc(df, "y", "p", single_task_rows=limit).first()[0] == pytest.approx(brute_auc(y, p), abs=1e-12)


def test_auc_with_a_hot_score(spark):
    data = [(i % 2, 0.5) for i in range(300)] + [(1, 0.9)] * 10 + [(0, 0.1)] * 10
    df = spark.createDataFrame(data, SCHEMA)
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx(brute_auc(*zip(*data)))


def test_auc_of_one_class_is_null_and_unknown_targets_are_left_out(spark):
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.5)], SCHEMA), "y", "p").first()[0] is None
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (-1, 0.95), (None, 0.0)], SCHEMA)
    assert metrics.roc_auc(df, "y", "p").first()[0] == 1.0


def test_auc_per_set(scored, spark):
    y, p, df = scored
    sets = df.withColumn("set", F.when(F.col("p") > 0.5, "high").otherwise("low"))
    found = dict(rows(metrics.roc_auc(sets, "y", "p", ["set"])))
    for name, keep in (("high", p > 0.5), ("low", p <= 0.5)):
        assert found[name] == pytest.approx(brute_auc(y[keep], p[keep]))


def test_undefined_rates_are_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], SCHEMA)
    r = metrics.threshold_metrics(df, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1_score"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


@pytest.mark.parametrize("n", [1, 3, 7, 10, 15])
def test_bins_follow_the_edges(spark, n):
    values = sorted({*np.round(np.linspace(0, 1, 101), 2), *bin_edges(n), 0.3, 0.7, 0.30000000000000004})
    df = spark.createDataFrame([(float(v),) for v in values], "p double")
    found = rows(df, "p", equal_width_bin("p", n))
    assert [b for _, b in found] == list(np.digitize([v for v, _ in found], np.linspace(0, 1, n + 1)) - 1)


def brute_ece(y, p, n=10):
    b, total = np.digitize(p, np.linspace(0, 1, n + 1)) - 1, 0.0
    for i in range(n):
        if (b == i).any():
            total += abs(y[b == i].mean() - p[b == i].mean()) * (b == i).sum() / len(y)
    return total


def test_ece(scored):
    y, p, df = scored
    assert metrics.expected_calibration_error(df, "y", "p").first()[0] == pytest.approx(brute_ece(y, p))


def test_ece_score_of_one(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.95)], SCHEMA)
    assert metrics.expected_calibration_error(df, "y", "p").first()[0] == pytest.approx(0.025)
    assert metrics.expected_calibration_error(df, "y", "p", include_one=True).first()[0] == pytest.approx(0.475)
    only = spark.createDataFrame([(0, 1.0)], SCHEMA)
    assert metrics.expected_calibration_error(only, "y", "p").first()[0] == 0.0


@pytest.mark.parametrize("limit", [10**6, 5])
def test_metrics_by_set_equal_the_single_metrics(scored, limit):
    _, _, df = scored
    sets = df.withColumn("set", F.when(F.col("p") * 100 % 2 > 0.5, "train").otherwise("validation"))
    sets = sets.withColumn("q", F.sqrt("p"))
    found = {r["set"]: r for r in metrics.metrics_by_set(sets, "y", "q", "p", single_task_rows=limit).collect()}
    for name in ("train", "validation"):
        part = sets.where(F.col("set") == name)
        rates = metrics.threshold_metrics(part, "y", "q").first()
        assert found[name]["roc_auc"] == pytest.approx(metrics.roc_auc(part, "y", "q").first()[0])
        assert found[name]["ece"] == pytest.approx(metrics.expected_calibration_error(part, "y", "p").first()[0])
        assert all(found[name][m] == pytest.approx(rates[m]) for m in ("precision", "recall", "f1_score"))


def test_report_with_a_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "y int, h int")
    found = {r["label"]: r for r in metrics.classification_report(df, "y", "h").collect()}
    assert (found["1"]["precision"], found["1"]["recall"], found["1"]["support"]) == (0.0, 0.0, 1)
    assert found["accuracy"]["f1_score"] == 0.75 and found["accuracy"]["precision"] is None
    assert found["macro avg"]["recall"] == pytest.approx(2 / 3)
    assert found["weighted avg"]["precision"] == pytest.approx((2 * (2 / 3) + 0 + 1) / 4)
    assert len(found) == 6


def test_isotonic_equals_pooling(spark, scored):
    y, p, df = scored
    order = np.argsort(p, kind="stable")
    blocks = []
    for s in np.unique(p[order]):
        hit = y[p == s]
        blocks.append([hit.sum(), len(hit), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2] + a[2]]
    expected = {s: b[0] / b[1] for b in blocks for s in b[2]}
    model = calibration.fit_isotonic(df, "y", "p")
    out = calibration.calibrate(df, model, "p").collect()
    assert all(r["calibrated"] == pytest.approx(expected[r["p"]]) for r in out)


def test_isotonic_clips_and_interpolates(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.8)], SCHEMA)
    model = calibration.fit_isotonic(df, "y", "p")
    new = spark.createDataFrame([(0.0, 9.0), (0.5, 9.0), (1.0, 9.0)], "p double, prediction double")
    out = calibration.calibrate(new, model, "p")
    assert out.columns == ["p", "prediction", "calibrated"]
    assert [round(c, 9) for *_, c in rows(out)] == [0.0, 0.5, 1.0]
    again = calibration.calibrate(out, model, "p")
    assert again.columns == out.columns


def test_losses(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 0.25)], SCHEMA)
    r = df.agg(average_loss("binary_crossentropy", "y", "p").alias("b"), average_loss("focal_loss", "y", "p").alias("f")).first()
    big = -np.log(1e-7)
    assert r["b"] == pytest.approx((2 * big - np.log(0.25)) / 3, rel=1e-6)
    assert r["f"] == pytest.approx((2 * big + 0.75**2 * -np.log(0.25)) / 3, rel=1e-5)


def test_focal_terms_at_extremes_are_finite(spark):
    df = spark.createDataFrame([(1, 1000.0), (0, 1000.0), (1, -1000.0), (0, 0.0)], "y int, z double")
    g, h = focal_terms(F.col("y"), F.col("z"))
    assert all(np.isfinite(v) for r in df.select(g, h).collect() for v in r)


@pytest.mark.parametrize("args", [("hinge",), ("focal_loss", 0.0), ("focal_loss", 0.25, -1.0)])
def test_loss_arguments(args):
    with pytest.raises(ValueError):
        check_loss(*args)


def test_bucketed_auc_is_close(scored):
    y, p, df = scored
    assert metrics.bucketed_auc(df, "y", "p").first()[0] == pytest.approx(brute_auc(y, p), abs=0.02)


def test_metric_of_ones_own(spark, scored):
    class Brier(metrics.Metric):
        def compute(self, df, label, score):
            return metrics.mean_squared_error(df, label, score).withColumnRenamed("mse", "brier")

    y, p, df = scored
    assert Brier().compute(df, "y", "p").first()["brier"] == pytest.approx(((y - p) ** 2).mean())
