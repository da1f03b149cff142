"""Split, train, calibrate and judge (MDL-1, 7; MET-5, 7)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.config import DECISION_THRESHOLD, SEED, TRAIN_FRACTION
from riskflow.functions.scalars import at_least, quoted
from riskflow.operators.calibration import calibrate, fit_isotonic
from riskflow.operators.metrics import classification_report, metrics_by_set
from riskflow.operators.models import BoostedTreesClassifier
from riskflow.operators.sampling import split_rows, undersample_negatives
from riskflow.session import materialise
from riskflow.sources.artefacts import read_settings, write_settings
from riskflow.sources.tables import write_csv_report


@dataclass
class TrainingResult:
    model: BoostedTreesClassifier
    calibrator: IsotonicRegressionModel
    scored: DataFrame | None
    metrics: DataFrame
    label: str

    def report(self, split: str, threshold: float = DECISION_THRESHOLD) -> DataFrame:
        """Classification report of one set at a threshold of the calibrated score."""
        rows = self.scored.where(F.col("set") == split)
        return classification_report(rows, self.label, at_least("calibrated", threshold))

    def score(self, df: DataFrame) -> DataFrame:
        """Raw and calibrated scores of new rows."""
        return calibrate(self.model.predict_proba(df, "score"), self.calibrator, "score", "calibrated")

    def write(self, spark: SparkSession, directory: str) -> None:
        self.model.save(f"{directory}/model")
        self.calibrator.write().overwrite().save(f"{directory}/calibrator")
        write_csv_report(self.metrics, f"{directory}/metrics")
        write_settings(spark, self.model._config(), f"{directory}/settings")

    @classmethod
    def read(cls, spark: SparkSession, directory: str) -> TrainingResult:
        """A written run: its model and calibrator score new rows, its metrics are as stored; ``scored`` is not kept."""
        settings = read_settings(spark, f"{directory}/settings")
        metrics = spark.read.option("header", True).option("inferSchema", True).csv(f"{directory}/metrics")
        calibrator = IsotonicRegressionModel.load(f"{directory}/calibrator")
        return cls(BoostedTreesClassifier.load(f"{directory}/model"), calibrator, None, metrics, settings["label"])


def train_and_judge(
    df: DataFrame,
    key: str | list[str],
    label: str,
    categorical: Sequence[str],
    numeric: Sequence[str],
    fraction: float = TRAIN_FRACTION,
    seed: int = SEED,
    balance: str | None = "weights",
    calibration_set: str = "train",
    stop_on_validation: bool = False,
    **params: Any,
) -> TrainingResult:
    """Train on the hash split, calibrate on ``calibration_set``, and give the metrics of both sets.

    ``balance`` is ``weights``, ``undersample`` or ``None``. Rows with an unknown target take no part.
    With ``stop_on_validation`` training ends when the other set stops gaining, otherwise it runs all its rounds. Scores are
    written once; calibration, metrics and reports all read that copy.
    """
    if balance not in ("weights", "undersample", None):
        raise ValueError("balance must be 'weights', 'undersample' or None")
    keys = [key] if isinstance(key, str) else list(key)
    rows = split_rows(df.where(quoted(label).isin(0, 1)), keys, fraction, seed)
    train = rows.where(F.col("set") == "train")
    if balance == "undersample":
        train = undersample_negatives(train, label, keys, seed)
    if stop_on_validation:
        train = train.withColumn("_held_out", F.lit(False)).unionByName(
            rows.where(F.col("set") != "train").withColumn("_held_out", F.lit(True))
        )
        params["validation"] = "_held_out"
    model = BoostedTreesClassifier(categorical, numeric, label, balanced=balance == "weights", **params).fit(train)
    raw = model.predict_proba(rows.select(*(quoted(c) for c in dict.fromkeys([*keys, label, *categorical, *numeric, "set"]))), "score")
    written = materialise(raw, "scores")
    calibrator = fit_isotonic(written.where(F.col("set") == calibration_set), label, "score")
    scored = calibrate(written, calibrator, "score", "calibrated")
    return TrainingResult(model, calibrator, scored, metrics_by_set(scored, label, "calibrated", "score"), label)
