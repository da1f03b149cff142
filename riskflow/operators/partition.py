"""User functions over batches of a table, and user-defined steps (UDF-1..8, FE-15)."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
import riskflow
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Steps travel to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(riskflow)

SCORING_BATCH = 4096


def apply_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """Run a pandas function on each Arrow batch of each partition.

    For code that has no native form only: the optimiser cannot look inside it or prune its input. The
    batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield function(batch)

    return df.mapInPandas(run, schema)


def score_batches(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str | T.StructType,
    rows: int = SCORING_BATCH,
) -> DataFrame:
    """Score with a foreign model: ``load`` runs once per task, its result once per at most ``rows`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            for start in range(0, len(batch), rows):
                yield scorer(batch.iloc[start : start + rows])

    return df.mapInPandas(run, schema)


class BatchStep(ABC):
    """A table step written in pandas by the user; ``output_schema`` must say what it returns."""

    output_schema: str | T.StructType | None = None

    def __init__(self, output_schema: str | T.StructType | None = None):
        self.output_schema = output_schema or self.output_schema

    @abstractmethod
    def compute_batch(self, batch: pd.DataFrame) -> pd.DataFrame: ...

    def compute(self, df: DataFrame | pd.DataFrame) -> DataFrame:
        """Accepts a Spark table, or a local frame which is distributed first."""
        if isinstance(df, pd.DataFrame):
            df = SparkSession.getActiveSession().createDataFrame(df)
        if not isinstance(df, DataFrame):
            raise TypeError("expected a Spark or pandas DataFrame")
        if not self.output_schema:
            raise ValueError("output_schema is required")
        return apply_batches(df, self.compute_batch, self.output_schema)


class TableStep(ABC):
    """A step with something to learn: ``fit`` on training rows, then ``transform`` any rows."""

    def fit(self, df: DataFrame) -> TableStep:
        return self

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...
