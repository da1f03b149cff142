"""Classification and calibration metrics as distributed aggregates (MET-1..9).

``by`` names columns with few values, such as the set; metrics are then given per value. Rows whose
label is not 0 or 1 (an unknown target) do not take part.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.config import DECISION_THRESHOLD, ECE_BINS, UNKNOWN_TARGET
from riskflow.functions.scalars import at_least, equal_width_bin, quoted, safe_ratio
from riskflow.operators.ordering import SINGLE_TASK_ROWS, running_total
from riskflow.session import materialise


def _labelled(df: DataFrame, label: str, *scores: str) -> DataFrame:
    rows = df.where(quoted(label).isin(0, 1))
    for s in scores:
        rows = rows.where(quoted(s).isNotNull())
    return rows


def _known(df: DataFrame, label: str) -> DataFrame:
    """Rows whose target is there and is not the mark of an unknown one."""
    return df.where(quoted(label).isNotNull() & (F.coalesce(quoted(label).try_cast("double"), F.lit(0.0)) != UNKNOWN_TARGET))


def roc_auc(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Exact area under the ROC curve: a tie between a positive and a negative counts one half.

    Rows are first combined to one per distinct score, so a score held by most rows is one row.
    """
    y = quoted(label)
    points = materialise(
        _labelled(df, label, score)
        .groupBy(*by, quoted(score).cast("double").alias("_score"))
        .agg(F.count_if(y == 1).alias("positive"), F.count_if(y == 0).alias("negative"))
    )
    return auc_from_points(points, "_score", by, single_task_rows)


def auc_from_points(
    points: DataFrame, score: str, by: Sequence[str] = (), single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Area from materialised (by, score, positive, negative) rows, distinct in score."""
    ordered = running_total(points, by, [F.col(score)], {"_upto": F.col("negative")}, single_task_rows)
    below = F.col("_upto") - F.col("negative") * F.lit(0.5)
    won = F.sum(F.col("positive").cast("double") * below)
    pairs = F.sum("positive").cast("double") * F.sum("negative").cast("double")
    return ordered.groupBy(*by).agg(F.try_divide(won, pairs).alias("roc_auc"))


def _confusion(y: Column, yhat: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((y == 1) & (yhat == 1)),
        "fp": F.count_if((y == 0) & (yhat == 1)),
        "fn": F.count_if((y == 1) & (yhat == 0)),
        "tn": F.count_if((y == 0) & (yhat == 0)),
    }


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": safe_ratio(tp + tn, tp + fp + fn + tn),
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
        "f1_score": safe_ratio(2 * tp, 2 * tp + fp + fn),
    }


def threshold_metrics(
    df: DataFrame, label: str, score: str, threshold: float = DECISION_THRESHOLD, by: Sequence[str] = ()
) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1_score for ``score >= threshold``."""
    counts = (
        _labelled(df, label, score)
        .groupBy(*by)
        .agg(*(c.alias(n) for n, c in _confusion(quoted(label), at_least(quoted(score), threshold)).items()))
    )
    rates = _rates(*(F.col(n) for n in ("tp", "fp", "fn", "tn")))
    return counts.select(*by, "tp", "fp", "fn", "tn", *(c.alias(n) for n, c in rates.items()))


def calibration_bins(
    df: DataFrame, label: str, score: str, n_bins: int = ECE_BINS, by: Sequence[str] = (), include_one: bool = False
) -> DataFrame:
    """(by, bin, count, accuracy, confidence) per equal-width bin of the score.

    A score of exactly 1 falls in the extra bin ``n_bins`` unless ``include_one`` puts it in the last.
    """
    b = equal_width_bin(quoted(score), n_bins)
    if include_one:
        b = F.when(quoted(score) == 1.0, F.lit(n_bins - 1)).otherwise(b)
    return (
        _labelled(df, label, score)
        .groupBy(*by, b.alias("bin"))
        .agg(
            F.count("*").alias("count"),
            F.avg(quoted(label).cast("double")).alias("accuracy"),
            F.avg(quoted(score)).alias("confidence"),
        )
    )


def expected_calibration_error(
    df: DataFrame, label: str, score: str, n_bins: int = ECE_BINS, by: Sequence[str] = (), include_one: bool = False
) -> DataFrame:
    """Mean gap between accuracy and confidence over the bins, weighted by their share of all rows.

    Scores outside [0, 1) are left out of the sum but stay in the number of rows.
    """
    bins = calibration_bins(df, label, score, n_bins, by, include_one)
    gap = F.abs(F.col("accuracy") - F.col("confidence")) * F.col("count")
    inside = F.col("bin").between(0, n_bins - 1)
    total = F.sum(F.when(inside, gap).otherwise(0.0))
    return bins.groupBy(*by).agg(F.try_divide(total, F.sum("count").cast("double")).alias("ece"))


def metrics_by_set(
    df: DataFrame,
    label: str,
    calibrated: str,
    raw: str,
    by: str = "set",
    threshold: float = DECISION_THRESHOLD,
    n_bins: int = ECE_BINS,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """(roc_auc, f1_score, precision, recall, ece, set): one row per set.

    All but the calibration error judge the calibrated score, from one row per distinct value of it; that one judges the raw
    score, whose bins are a direct aggregate, a few rows a task.
    """
    y = quoted(label)
    points = materialise(
        _labelled(df, label, calibrated, raw)
        .groupBy(quoted(by).alias(by), quoted(calibrated).alias("_calibrated"))
        .agg(F.count_if(y == 1).alias("positive"), F.count_if(y == 0).alias("negative"))
    )
    auc = auc_from_points(points, "_calibrated", [by], single_task_rows)

    hit = F.col("_calibrated") >= threshold
    zero = F.lit(0)
    tp, fp = F.sum(F.when(hit, F.col("positive")).otherwise(zero)), F.sum(F.when(hit, F.col("negative")).otherwise(zero))
    fn, tn = F.sum(F.when(hit, zero).otherwise(F.col("positive"))), F.sum(F.when(hit, zero).otherwise(F.col("negative")))
    rates = points.groupBy(by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    named = _rates(*(F.col(n) for n in ("tp", "fp", "fn", "tn")))
    rates = rates.select(by, *(c.alias(n) for n, c in named.items()))

    ece = expected_calibration_error(_labelled(df, label, calibrated, raw), label, raw, n_bins, [by])
    return auc.join(rates, by).join(ece, by).select("roc_auc", "f1_score", "precision", "recall", "ece", by)


def classification_report(df: DataFrame, label: str, prediction: str | Column) -> DataFrame:
    """(label, precision, recall, f1_score, support) per class, then accuracy and the two averages.

    Rows with an unknown target take no part. The summary rows are told apart from classes of the same name.
    """
    yhat = quoted(prediction) if isinstance(prediction, str) else prediction
    confusion = (
        _known(df, label).select(quoted(label).cast("string").alias("y"), yhat.cast("string").alias("yhat"))
        .groupBy("y", "yhat")
        .agg(F.count("*").alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("y").alias("label"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
            F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(zero).alias("right"),
        ),
        F.struct(F.col("yhat").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("right")),
    )
    classes = (
        confusion.select(F.explode(sides).alias("_s"))
        .groupBy("_s.label")
        .agg(
            F.sum("_s.support").alias("support"), F.sum("_s.predicted").alias("predicted"), F.sum("_s.right").alias("right")
        )
        .select(
            "label",
            "support",
            "right",
            safe_ratio(F.col("right"), F.col("predicted")).alias("precision"),
            safe_ratio(F.col("right"), F.col("support")).alias("recall"),
            safe_ratio(2 * F.col("right"), F.col("predicted") + F.col("support")).alias("f1_score"),
        )
    )
    # Each class row also feeds the three summary rows, so the table is scanned once.
    summary = ("accuracy", "macro avg", "weighted avg")
    rows = [F.struct(F.lit(True).alias("own"), F.col("label").alias("row"))]
    rows += [F.struct(F.lit(False).alias("own"), F.lit(s).alias("row")) for s in summary]
    fed = classes.withColumn("_row", F.explode(F.array(*rows))).select("*", "_row.own", "_row.row")

    def shown(name: str, accuracy: Column) -> Column:
        weighted = safe_ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))
        row = F.when(~F.col("own"), F.col("row"))
        return F.when(row == "accuracy", accuracy).when(row == "weighted avg", weighted).otherwise(F.avg(name)).alias(name)

    overall = safe_ratio(F.sum("right"), F.sum("support"))
    none = F.lit(None).cast("double")
    return (
        fed.groupBy("own", "row")
        .agg(
            shown("precision", none), shown("recall", none), shown("f1_score", overall), F.sum("support").alias("support")
        )
        .withColumnRenamed("row", "label")
        .drop("own")
    )


def mean_squared_error(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(quoted(label) - quoted(prediction), F.lit(2))).alias("mse"))


def accuracy(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows predicted right, of those with a known target."""
    hit = (quoted(label) == quoted(prediction)).cast("double")
    return _known(df, label).groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def bucketed_auc(df: DataFrame, label: str, score: str, buckets: int = 200) -> DataFrame:
    """Area under the curve through ``buckets`` even thresholds, the first below 0 and the last above 1, by trapezoids.

    Scores between the same two thresholds are ties, so one aggregate of at most ``buckets`` rows has it all.
    """
    steps = buckets - 1
    s, near = quoted(score).cast("double"), F.ceil(quoted(score) * F.lit(steps))
    # Rounding can put a score on the wrong side of its threshold; compare with the thresholds themselves.
    passed = near - (F.lit(1.0) * (near - 1) / steps >= s).cast("bigint") + (F.lit(1.0) * near / steps < s).cast("bigint")
    y = quoted(label)
    points = (
        _labelled(df, label, score)
        .groupBy(F.least(F.greatest(passed, F.lit(1)), F.lit(steps)).alias("passed"))
        .agg(F.count_if(y == 1).alias("positive"), F.count_if(y == 0).alias("negative"))
    )
    return auc_from_points(materialise(points), "passed").withColumnRenamed("roc_auc", "bucketed_auc")


class Metric(ABC):
    """A metric of one's own: from a table with label and score columns to a one-row table."""

    @abstractmethod
    def compute(self, df: DataFrame, label: str, score: str) -> DataFrame: ...


class ExpectedCalibrationError(Metric):
    def __init__(self, n_bins: int = ECE_BINS):
        self.n_bins = n_bins

    def compute(self, df: DataFrame, label: str, score: str) -> DataFrame:
        return expected_calibration_error(df, label, score, self.n_bins)
