"""Standard scaling with statistics fitted on training rows (FE-3, FE-4)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.scalars import number, standardise
from riskflow.operators.columns import numeric_columns


@dataclass(frozen=True)
class Scaling:
    """Mean and sample deviation per column: one small row of numbers, whatever the table size."""

    parameters: dict[str, tuple[float | None, float | None]]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, m, s) for c, (m, s) in self.parameters.items()]
        return spark.createDataFrame(rows, "column string, mean double, std double")

    @staticmethod
    def from_table(table: DataFrame) -> Scaling:
        return Scaling({r["column"]: (r["mean"], r["std"]) for r in table.collect()})


def fit_scaling(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> Scaling:
    """Statistics of all numeric columns (or those given) in one aggregate pass."""
    names = list(columns) if columns is not None else numeric_columns(df, exclude)
    if not names:
        return Scaling({})
    aggregates = []
    for i, c in enumerate(names):
        x = number(df.schema[c])
        aggregates += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    row = df.agg(*aggregates).first()
    return Scaling({c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(names)})


def apply_scaling(df: DataFrame, scaling: Scaling) -> DataFrame:
    """Replace each fitted column that the table has by its scaled value; no shuffle, prunable."""
    return df.withColumns(
        {
            c: standardise(number(df.schema[c]), mean, std)
            for c, (mean, std) in scaling.parameters.items()
            if c in df.columns
        }
    )
