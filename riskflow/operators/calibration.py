"""Isotonic calibration of scores (MDL-7)."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.scalars import quoted


def fit_isotonic(df: DataFrame, label: str, score: str) -> IsotonicRegressionModel:
    """Non-decreasing fit of the label on the score.

    Rows are combined to one weighted point per distinct score first: the fit is the same, and Spark
    then pools within score ranges in parallel, so only pooled blocks meet for the last pass.
    """
    points = (
        df.where(quoted(label).isin(0, 1) & quoted(score).isNotNull())
        .groupBy(quoted(score).cast("double").alias("features"))
        .agg(F.avg(quoted(label).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    )
    return IsotonicRegression(weightCol="weight").fit(points)


def calibrate(df: DataFrame, model: IsotonicRegressionModel, score: str, name: str = "calibrated") -> DataFrame:
    """Append the calibrated score: linear between the fitted points, clipped outside them."""
    scorer = model.copy().setFeaturesCol(score).setPredictionCol(name)
    return scorer.transform(df.drop(name))
