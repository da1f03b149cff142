"""Group categories, scale numbers, cast and select: merged table to processed table (FE-10)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskflow.config import CATEGORY_SHARE, NULL_TOKEN, OTHER
from riskflow.operators.categorical import apply_category_mapping, fit_category_mapping
from riskflow.operators.columns import categories_to_text, select_features
from riskflow.operators.scaling import Scaling, apply_scaling, fit_scaling
from riskflow.sources.artefacts import read_mapping, read_scaling, write_mapping, write_scaling
from riskflow.sources.commit import commit_parquet


@dataclass
class FeatureSteps:
    """What was learned from training rows, ready to apply to any split."""

    features: list[str]
    target: str | None
    categorical: list[str]
    mapping: DataFrame | None
    scaling: Scaling
    other: str = OTHER
    null_token: str | None = NULL_TOKEN

    def transform(self, df: DataFrame) -> DataFrame:
        """Column expressions only, so scans read just the selected columns."""
        present = [c for c in self.categorical if c in df.columns]
        if self.mapping is not None and present:
            df = apply_category_mapping(df, self.mapping, present, self.other, self.null_token)
        df = apply_scaling(df, self.scaling)
        df = categories_to_text(df, present, self.null_token)
        return select_features(df, self.features, self.target)

    def write(self, spark: SparkSession, directory: str) -> None:
        if self.mapping is not None:
            write_mapping(self.mapping, f"{directory}/mapping")
        write_scaling(self.scaling.table(spark), f"{directory}/scaling")

    def read(self, spark: SparkSession, directory: str) -> FeatureSteps:
        """The same steps with stored statistics."""
        mapping = read_mapping(spark, f"{directory}/mapping") if self.categorical else None
        scaling = Scaling.from_table(read_scaling(spark, f"{directory}/scaling"))
        return FeatureSteps(
            self.features, self.target, self.categorical, mapping, scaling, self.other, self.null_token
        )


def fit_features(
    train: DataFrame,
    features: Sequence[str],
    target: str | None,
    categorical: Sequence[str],
    key: str | None = None,
    share: float = CATEGORY_SHARE,
    other: str = OTHER,
    null_token: str | None = NULL_TOKEN,
    scale: Sequence[str] | None = None,
) -> FeatureSteps:
    """Learn the category mapping and the scaling from training rows: two scans in all.

    Every numeric column is scaled unless ``scale`` names them; the key, the target and the categorical
    columns never are.
    """
    grouped = [c for c in categorical if c in train.columns]
    mapping = fit_category_mapping(train, grouped, share, other, null_token) if grouped else None
    excluded = [*grouped, *(c for c in (key, target) if c)]
    return FeatureSteps(
        list(features), target, grouped, mapping, fit_scaling(train, scale, excluded), other, null_token
    )


def write_processed(steps: FeatureSteps, tables: dict[str, DataFrame], directory: str) -> None:
    """One processed table per split, each whole or absent."""
    for split, df in tables.items():
        commit_parquet(steps.transform(df), f"{directory}/{split}")
