"""Boosted-tree models behind one interface: fit, predict, evaluate, save, load (MDL-1..6, 8..11, 16)."""

from __future__ import annotations

import json
import math
from abc import ABC, abstractmethod
from collections.abc import Sequence
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.scalars import number, quoted
from riskflow.operators import metrics
from riskflow.operators.joins import lookup
from riskflow.operators.ordering import running_total, value_counts_long
from riskflow.operators.profile import distinct_counts
from riskflow.operators.sampling import with_class_weights
from riskflow.session import dealt, materialise

# Defaults for the two uses of boosted trees: the trained model and the quick look.
TRAINING_PARAMS = {"maxIter": 1000, "stepSize": 0.1, "maxDepth": 5, "seed": 42}
EXPLORATION_PARAMS = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 6, "seed": 42}
MAX_BINS = 255
MODEL_OUTPUTS = ("_features", "rawPrediction", "probability", "prediction")


class TabularModel(ABC):
    """Interface for models of one's own."""

    @abstractmethod
    def fit(self, df: DataFrame) -> TabularModel: ...

    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame: ...

    @abstractmethod
    def evaluate(self, df: DataFrame, metric: str) -> float: ...

    @abstractmethod
    def save(self, path: str) -> None: ...


class _BoostedTrees(TabularModel):
    default_metric = ""

    def __init__(
        self,
        categorical: Sequence[str] = (),
        numeric: Sequence[str] = (),
        label: str = "label",
        frequency: Sequence[str] = (),
        max_bins: int = MAX_BINS,
        validation: str | None = None,
        **params: Any,
    ):
        unknown = [c for c in frequency if c not in categorical]
        if unknown:
            raise ValueError(f"frequency columns are not categorical: {unknown}")
        self.categorical, self.numeric, self.label = list(categorical), list(numeric), label
        self.frequency, self.max_bins = list(frequency), max_bins
        self.validation, self.params = validation, dict(params)
        self.shares: DataFrame | None = None  # (column, value, share) of the frequency columns
        self.model: PipelineModel | None = None
        self.cuts: dict[str, list[float]] = {}  # of numbers with more than max_bins values

    # -- features ------------------------------------------------------------------------------
    def _category(self, c: str) -> Column:
        return F.coalesce(quoted(c).cast("string"), F.lit("nan")).alias(f"_text_{c}")

    @property
    def indexed(self) -> list[str]:
        """Categorical columns whose values are told apart by the trees."""
        return [c for c in self.categorical if c not in self.frequency]

    def _with_shares(self, df: DataFrame) -> DataFrame:
        for c in self.frequency:
            table = self.shares.where(F.col("column") == c)
            df = lookup(df, F.col(f"_text_{c}"), table, "value", "share", f"_share_{c}", F.lit(0.0), "share")
        return df

    def _prepare(self, df: DataFrame) -> DataFrame:
        """Text categories, and numbers with missing ones as 0 beside an indicator."""
        columns = [self._category(c) for c in self.categorical]
        for c in self.numeric:
            x = number(df.schema[c])
            columns += [F.coalesce(x, F.lit(0.0)).alias(f"_value_{c}"), x.isNull().cast("double").alias(f"_missing_{c}")]
        return df.select("*", *columns)

    @property
    def feature_names(self) -> list[str]:
        """Names of the vector positions the trees see."""
        return [*self.categorical, *self.numeric, *(f"{c}_missing" for c in self.numeric)]

    def _estimator(self):
        raise NotImplementedError

    # -- fit and score ---------------------------------------------------------------------------
    def fit(self, df: DataFrame) -> _BoostedTrees:
        """Train on the rows of ``df``; with ``validation`` set, stop when the flagged rows stop gaining.

        The training columns are written once, since every boosting round reads them again. Numbers with more than
        ``max_bins`` values are told apart by that many equally filled ranges, and rows that the trees can't tell apart are one
        row with their weight: what a round reads is bounded by the ranges and categories, not by the rows of ``df``.
        """
        table, stages, bins = self._training_table(df)
        trained = self._train(self._dealt(table), stages, bins)
        self.model = PipelineModel([*self._ranges(), *trained.stages])
        return self

    def _ranges(self) -> list[Bucketizer]:
        """The stage that turns numbers with many values into their range."""
        if not self.cuts:
            return []
        splits = [[-math.inf, *cuts, math.inf] for cuts in self.cuts.values()]
        return [Bucketizer(inputCols=list(self.cuts), outputCols=[f"_range{c}" for c in self.cuts], splitsArray=splits, handleInvalid="keep")]

    def _single_rows(self) -> bool:
        """Whether the trees draw or count single rows, so that equal ones may not be put together."""
        return self.params.get("subsamplingRate", 1.0) != 1.0 or self.params.get("minInstancesPerNode", 1) != 1

    def _grouped(self, table: DataFrame) -> DataFrame:
        """``table`` with one row and the summed weight of those that are equal."""
        if self._single_rows():
            return table
        weight = F.col("_weight") if "_weight" in table.columns else F.lit(1.0)
        counted = table.groupBy(*(quoted(c) for c in table.columns)).agg(F.count("*").alias("_rows"))
        return counted.select(*(quoted(c) for c in table.columns if c != "_weight"), (weight * F.col("_rows")).alias("_weight"))

    def _dealt(self, table: DataFrame) -> DataFrame:
        """Training rows in partitions of a bounded number: trees hold those of a task as objects, each time that they read them."""
        return dealt(table, None if self._single_rows() else [c for c in table.columns if c not in ("_label", "_weight")])

    def _enough(self, table: DataFrame, rows: int) -> DataFrame:
        """Spark wants no fewer training rows than a column has categories: a few grouped ones are cut into parts of their weight."""
        trained = (table.where(~quoted(self.validation).cast("boolean")) if self.validation else table).count()
        if not 0 < trained < rows or "_weight" not in table.columns:
            return table
        parts = math.ceil(rows / trained)
        return table.withColumn("_weight", F.explode(F.array_repeat(F.col("_weight") / parts, parts)))

    def _training_table(self, df: DataFrame) -> tuple[DataFrame, list, int]:
        """The written training columns, the stages that make a vector of them, and the bins that their categories need."""
        prepared = self._prepare(self._weighted(df))
        if self.frequency:
            values = value_counts_long(prepared, {c: F.col(f"_text_{c}") for c in self.frequency})
            share = F.col("count") / F.lit(float(df.count()))
            self.shares = materialise(values.select("column", "value", share.alias("share")), "shares")
        prepared = self._with_shares(prepared)
        inputs = [c for c in prepared.columns if c.startswith(("_text_", "_value_", "_missing_", "_share_"))]
        extra = [c for c in ("_weight", self.validation) if c and c in prepared.columns]
        trained = prepared.where(~quoted(self.validation).cast("boolean")) if self.validation else prepared
        self.cuts = value_cuts(trained, [c for c in inputs if c.startswith(("_value_", "_share_"))], self.max_bins)
        for stage in self._ranges():
            prepared = stage.transform(prepared)
        # Adding 0 drops the mark of a category.
        features = [(F.col(f"_range{c}") + F.lit(0.0)).alias(f"_range{c}") if c in self.cuts else quoted(c) for c in inputs]
        columns = prepared.select(quoted(self.label).cast("double").alias("_label"), *features, *(quoted(c) for c in extra))
        table = materialise(self._grouped(columns), "grouped")
        stages: list = []
        bins = self.max_bins
        if self.indexed:
            counts = {r["column_name"]: r["distinct_count"] for r in distinct_counts(table, [f"_text_{c}" for c in self.indexed]).collect()}
            wide = [c for c in self.indexed if counts[f"_text_{c}"] > self.max_bins]
            if wide:
                raise ValueError(f"more than max_bins={self.max_bins} values in {wide}: name them in frequency, or raise max_bins")
            indexer = StringIndexer(
                inputCols=[f"_text_{c}" for c in self.indexed],
                outputCols=[f"_index_{c}" for c in self.indexed],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",  # rows that are equal are one
            ).fit(table)
            stages.append(indexer)
            bins = max(bins, *(len(labels) + 1 for labels in indexer.labelsArray))
            table = self._enough(table, bins)
        vector = [f"_{'share' if c in self.frequency else 'index'}_{c}" for c in self.categorical]
        vector += [f"_value_{c}" for c in self.numeric] + [f"_missing_{c}" for c in self.numeric]
        stages.append(VectorAssembler(inputCols=[f"_range{c}" if c in self.cuts else c for c in vector], outputCol="_features"))
        return table, stages, bins

    def _train(self, table: DataFrame, stages: list, bins: int) -> PipelineModel:
        trees = self._estimator().setFeaturesCol("_features").setLabelCol("_label").setMaxBins(bins)
        if self.validation:
            trees = trees.setValidationIndicatorCol(self.validation)
        if "_weight" in table.columns:
            trees = trees.setWeightCol("_weight")
        return Pipeline(stages=[*stages, trees]).fit(table)

    def _weighted(self, df: DataFrame) -> DataFrame:
        return df

    def _fitted(self) -> PipelineModel:
        if self.model is None:
            raise RuntimeError("the model has not been fitted")
        return self.model

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the model's output columns, which replace columns of the same name."""
        model = self._fitted()
        scored = model.transform(self._with_shares(self._prepare(df.drop(*MODEL_OUTPUTS))))
        return scored.drop(*(c for c in scored.columns if c.startswith(("_text_", "_value_", "_missing_", "_index_", "_share_", "_range_"))))

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with a ``prediction`` column."""
        kept = [c for c in df.columns if c != "prediction"]
        return self.transform(df).select(*(quoted(c) for c in kept), "prediction")

    def importances(self, top: int | None = None) -> DataFrame:
        """Named importances, ranked, with their running sum."""
        trees = self._fitted().stages[-1]
        values = trees.featureImportances.toArray()
        rows = [(float(v), n) for v, n in zip(values, self.feature_names, strict=True)]
        spark = SparkSession.getActiveSession()
        table = spark.createDataFrame(rows, "feature_importance double, feature_name string")
        ranked = rank_importances(table)
        return ranked.where(F.col("feature_importance_rank") <= top) if top else ranked

    @property
    def rounds(self) -> int:
        return self._fitted().stages[-1].getNumTrees

    # -- storage -----------------------------------------------------------------------------------
    def _config(self) -> dict[str, Any]:
        return {
            "categorical": self.categorical,
            "numeric": self.numeric,
            "label": self.label,
            "frequency": self.frequency,
            "max_bins": self.max_bins,
            "validation": self.validation,
            "params": self.params,
        }

    def save(self, path: str) -> None:
        """Stages under ``path/model``; parameters and ordered features as JSON under ``path/config``."""
        self._fitted().write().overwrite().save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        row = spark.createDataFrame([(json.dumps(self._config()),)], "config string")
        row.coalesce(1).write.mode("overwrite").text(f"{path}/config")
        if self.shares is not None:
            self.shares.write.mode("overwrite").parquet(f"{path}/shares")

    @classmethod
    def load(cls, path: str) -> _BoostedTrees:
        spark = SparkSession.getActiveSession()
        config = json.loads(spark.read.text(f"{path}/config").first()["value"])
        params = config.pop("params")
        loaded = cls(**{k: v for k, v in config.items()}, **params)
        loaded.model = PipelineModel.load(f"{path}/model")
        if loaded.frequency:
            loaded.shares = spark.read.parquet(f"{path}/shares")
        return loaded


class BoostedTreesClassifier(_BoostedTrees):
    """Binary classifier; ``balanced`` weighs the classes by ``n / (2 * count)``."""

    def __init__(self, *args: Any, balanced: bool = False, **kwargs: Any):
        super().__init__(*args, **kwargs)
        self.balanced = balanced

    def _estimator(self) -> GBTClassifier:
        return GBTClassifier(**{**TRAINING_PARAMS, **self.params})

    def _weighted(self, df: DataFrame) -> DataFrame:
        return with_class_weights(df, self.label, "_weight") if self.balanced else df

    def _config(self) -> dict[str, Any]:
        return {**super()._config(), "balanced": self.balanced}

    def predict_proba(self, df: DataFrame, name: str = "score") -> DataFrame:
        """``df`` with the probability of the positive class."""
        return self._appended(df, "probability", name)

    def margins(self, df: DataFrame, name: str = "margin") -> DataFrame:
        """``df`` with the raw margin of the positive class."""
        return self._appended(df, "rawPrediction", name)

    def _appended(self, df: DataFrame, output: str, name: str) -> DataFrame:
        held = [(c, f"_held_{i}") for i, c in enumerate(df.columns) if c in MODEL_OUTPUTS]
        scored = self.transform(df.withColumnsRenamed(dict(held)))
        back = dict(held)
        kept = [quoted(back.get(c, c)).alias(c) for c in df.columns if c != name]
        return scored.select(*kept, vector_to_array(output)[1].alias(name))

    def evaluate(self, df: DataFrame, metric: str = "roc_auc") -> float:
        return self.evaluate_all(df, [metric])[metric]

    def evaluate_all(self, df: DataFrame, names: Sequence[str] = ("roc_auc", "accuracy")) -> dict[str, float]:
        """Several metrics of one scoring run: the scores are written once."""
        for name in names:
            if name not in ("roc_auc", "accuracy"):
                raise ValueError(f"unsupported metric {name!r}: use roc_auc or accuracy")
        scored = self.transform(df.drop("_score")).select(quoted(self.label).alias("_y"), "prediction", vector_to_array("probability")[1].alias("_score"))
        scored = materialise(scored, "scores")
        found = {
            "roc_auc": lambda: metrics.roc_auc(scored, "_y", "_score").first()["roc_auc"],
            "accuracy": lambda: metrics.accuracy(scored, "_y", "prediction").first()["accuracy"],
        }
        return {name: found[name]() for name in names}


class BoostedTreesRegressor(_BoostedTrees):
    def _estimator(self) -> GBTRegressor:
        return GBTRegressor(**{**TRAINING_PARAMS, **self.params})

    def _grouped(self, table: DataFrame) -> DataFrame:
        """Rows with equal features become two, a deviation above and below their mean: weight, sum and sum of squares
        stay what they were, and squared error depends on nothing else."""
        if self._single_rows() or self.params.get("lossType", "squared") != "squared":
            return super()._grouped(table)
        keys = [quoted(c) for c in table.columns if c not in ("_weight", "_label")]
        unknown = F.col("_label").isNull() | F.isnan("_label")  # such a row fails in training and must not vanish in a mean
        moments = table.groupBy(*keys, unknown.alias("_unknown")).agg(
            F.count("*").cast("double").alias("_weight"), F.avg("_label").alias("_mean"), F.stddev_pop("_label").alias("_off")
        )
        half = moments.withColumn("_label", F.explode(F.when(F.col("_off") > 0, F.array(F.col("_mean") - F.col("_off"), F.col("_mean") + F.col("_off"))).otherwise(F.array("_mean"))))
        weight = F.when(F.col("_off") > 0, F.col("_weight") / 2).otherwise(F.col("_weight"))
        return half.select("_label", *keys, weight.alias("_weight"))

    def evaluate(self, df: DataFrame, metric: str = "mse") -> float:
        if metric != "mse":
            raise ValueError(f"unsupported metric {metric!r}: use mse")
        return metrics.mean_squared_error(self.predict(df), self.label, "prediction").first()["mse"]


def value_cuts(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """For columns with more than ``bins`` values, where to cut them into at most ``bins`` ranges of about equally many rows.

    Exact: a value goes by the place of its middle row, so one that holds many rows has a range of its own.
    """
    if not columns:
        return {}
    counts = materialise(value_counts_long(df, {c: quoted(c) for c in columns}), "values")
    totals = counts.groupBy("column").agg(F.sum("count").alias("rows"), F.count("*").alias("values")).where(F.col("values") > bins)
    rows = {r["column"]: r["rows"] for r in totals.collect()}  # one row a column
    if not rows:
        return {}
    ranked = running_total(counts.where(F.col("column").isin(list(rows))), ["column"], [F.col("value")], {"upto": F.col("count")})
    n = F.create_map(*(F.lit(x) for pair in rows.items() for x in pair))[F.col("column")]
    place = F.floor(F.lit(bins) * (F.col("upto") - F.col("count") / 2) / n)
    least = ranked.groupBy("column", place.alias("place")).agg(F.min("value").alias("least"))
    found: dict[str, list[float]] = {c: [] for c in columns if c in rows}
    for r in least.orderBy("column", "place").collect():  # at most bins rows a column
        found[r["column"]].append(r["least"])
    return {c: [x for x in values[1:] if math.isfinite(x)] for c, values in found.items()}


def rank_importances(table: DataFrame) -> DataFrame:
    """Append ``feature_importance_rank`` (unique, ties by name) and ``cumulative_importances``.

    ``table`` has one row per feature: (feature_importance, feature_name).
    """
    order = [F.desc("feature_importance"), F.asc("feature_name")]
    amounts = {
        "feature_importance_rank": F.lit(1).cast("bigint"),
        "cumulative_importances": F.col("feature_importance"),
    }
    return running_total(table, [], order, amounts).orderBy("feature_importance_rank")
