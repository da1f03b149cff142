"""The library's steps as Spark ML stages: grouping, scaling, boosted trees and their evaluator (UDF-7, UDF-8, MDL-16).

They fit ``Pipeline``, ``CrossValidator`` and their persistence: parameters are ``Params``, fitted tables are stored as Parquet
or JSON below the stage's own folder.
"""

from __future__ import annotations

from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from riskflow.config import CATEGORY_SHARE
from riskflow.operators import metrics
from riskflow.operators.categorical import apply_category_mapping, fit_category_mapping
from riskflow.operators.models import TRAINING_PARAMS, BoostedTreesClassifier
from riskflow.operators.scaling import Scaling, apply_scaling, fit_scaling
from riskflow.sources.artefacts import read_mapping, read_scaling, write_mapping, write_scaling


class _Given(Params):
    """Parameters by keyword, as Spark's own stages take them."""

    def _set_given(self, given: dict[str, Any]) -> None:
        self._set(**{k: v for k, v in given.items() if v is not None})

    def get(self, name: str) -> Any:
        return self.getOrDefault(self.getParam(name))


class _FittedWriter(MLWriter):
    def __init__(self, stage: _Fitted) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage._save_data(self.sparkSession, f"{path}/data")


class _FittedReader(MLReader):
    def __init__(self, kind: type[_Fitted]) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _Fitted:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage._load_data(self.sparkSession, f"{path}/data")
        return stage


class _Fitted(Model, _Given, MLWritable, MLReadable):
    """A fitted stage: its parameters, and data that ``_save_data`` writes and ``_load_data`` reads."""

    def write(self) -> MLWriter:
        return _FittedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FittedReader(cls)

    def _save_data(self, spark: SparkSession, path: str) -> None:
        raise NotImplementedError

    def _load_data(self, spark: SparkSession, path: str) -> None:
        raise NotImplementedError


# -- grouping ----------------------------------------------------------------------------------------
class _GroupingParams(_Given):
    columns = Param(Params._dummy(), "columns", "categorical columns", TypeConverters.toListString)
    share = Param(Params._dummy(), "share", "cumulative percentage up to which values keep their name", TypeConverters.toFloat)
    other = Param(Params._dummy(), "other", "name of all other values", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(columns=[], share=CATEGORY_SHARE, other="Other")


class CategoryGrouping(Estimator, _GroupingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Rare values of the columns become one."""

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, share: float | None = None, other: str | None = None) -> None:
        super().__init__()
        self._set_given(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CategoryGroupingModel:
        model = self._copyValues(CategoryGroupingModel())
        model.mapping = fit_category_mapping(dataset, self.get("columns"), self.get("share"), self.get("other"))
        return model


class CategoryGroupingModel(_Fitted, _GroupingParams):
    mapping: DataFrame | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_category_mapping(dataset, self.mapping, self.get("columns"), self.get("other"))

    def _save_data(self, spark: SparkSession, path: str) -> None:
        write_mapping(self.mapping, path)

    def _load_data(self, spark: SparkSession, path: str) -> None:
        self.mapping = read_mapping(spark, path)


# -- scaling -----------------------------------------------------------------------------------------
class _ScalingParams(_Given):
    columns = Param(Params._dummy(), "columns", "numeric columns; all but the excluded without", TypeConverters.toListString)
    exclude = Param(Params._dummy(), "exclude", "columns that stay as they are", TypeConverters.toListString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(columns=[], exclude=[])


class StandardScaling(Estimator, _ScalingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers as distances from their mean in sample deviations."""

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, exclude: list[str] | None = None) -> None:
        super().__init__()
        self._set_given(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> StandardScalingModel:
        model = self._copyValues(StandardScalingModel())
        model.scaling = fit_scaling(dataset, self.get("columns") or None, self.get("exclude"))
        return model


class StandardScalingModel(_Fitted, _ScalingParams):
    scaling: Scaling | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_scaling(dataset, self.scaling)

    def _save_data(self, spark: SparkSession, path: str) -> None:
        write_scaling(self.scaling.table(spark), path)

    def _load_data(self, spark: SparkSession, path: str) -> None:
        self.scaling = Scaling.from_table(read_scaling(spark, path))


# -- boosted trees -------------------------------------------------------------------------------------
class _TreesParams(_Given):
    categorical = Param(Params._dummy(), "categorical", "categorical features", TypeConverters.toListString)
    numeric = Param(Params._dummy(), "numeric", "numeric features", TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "target, 0 or 1", TypeConverters.toString)
    balanced = Param(Params._dummy(), "balanced", "weigh the classes alike", TypeConverters.toBoolean)
    maxIter = Param(Params._dummy(), "maxIter", "rounds at most", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "rate of learning", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(categorical=[], numeric=[], label="label", balanced=False, **TRAINING_PARAMS)


class BoostedTrees(Estimator, _TreesParams, DefaultParamsReadable, DefaultParamsWritable):
    """``BoostedTreesClassifier`` as a stage; its model appends ``score`` and ``predicted``."""

    @keyword_only
    def __init__(
        self, *, categorical: list[str] | None = None, numeric: list[str] | None = None, label: str | None = None,
        balanced: bool | None = None, maxIter: int | None = None, maxDepth: int | None = None, stepSize: float | None = None,
        seed: int | None = None,
    ) -> None:
        super().__init__()
        self._set_given(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        model = self._copyValues(BoostedTreesModel())
        options = {p: self.get(p) for p in TRAINING_PARAMS}
        names = (self.get("categorical"), self.get("numeric"), self.get("label"))
        model.trees = BoostedTreesClassifier(*names, balanced=self.get("balanced"), **options).fit(dataset)
        return model


class BoostedTreesModel(_Fitted, _TreesParams):
    trees: BoostedTreesClassifier | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self.trees.predict_proba(dataset, "score")
        return scored.withColumn("predicted", (scored["score"] > 0.5).cast("int"))

    def _save_data(self, spark: SparkSession, path: str) -> None:
        self.trees.save(path)

    def _load_data(self, spark: SparkSession, path: str) -> None:
        self.trees = BoostedTreesClassifier.load(path)


class ScoreEvaluator(Evaluator, _Given, DefaultParamsReadable, DefaultParamsWritable):
    """Exact ROC AUC of a score, accuracy of a prediction, or calibration error of a score, for ``CrossValidator`` and alone."""

    label = Param(Params._dummy(), "label", "target", TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "roc_auc, accuracy or ece", TypeConverters.toString)
    score = Param(Params._dummy(), "score", "score, or prediction for accuracy", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, label: str | None = None, metric: str | None = None, score: str | None = None) -> None:
        super().__init__()
        self._setDefault(label="label", metric="roc_auc", score="score")
        self._set_given(self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        columns, metric = (self.get("label"), self.get("score")), self.get("metric")
        if metric == "roc_auc":
            return metrics.roc_auc(dataset, *columns).first()["roc_auc"]
        if metric == "accuracy":
            return metrics.accuracy(dataset, *columns).first()["accuracy"]
        if metric == "ece":
            return metrics.expected_calibration_error(dataset, *columns).first()["ece"]
        raise ValueError(f"unsupported metric {metric!r}: use roc_auc, accuracy or ece")

    def isLargerBetter(self) -> bool:
        return self.get("metric") != "ece"
