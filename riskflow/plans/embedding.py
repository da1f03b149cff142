"""Append row embeddings to every split and train on the widened table (FE-11, SNK-8, MDL-13)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.operators.embeddings import RowEncoder, fit_row_encoder
from riskflow.sources.tables import write_parquet


def append_embeddings(
    tables: dict[str, DataFrame], categorical: Sequence[str], numeric: Sequence[str] = (), size: int = 8, **options
) -> tuple[dict[str, DataFrame], RowEncoder]:
    """Train token vectors on the ``train`` table and append the row vectors to every table."""
    if "train" not in tables:
        raise ValueError("tables must contain 'train'")
    encoder = fit_row_encoder(tables["train"], categorical, numeric, size, **options)
    return {split: encoder.transform(df) for split, df in tables.items()}, encoder


def write_splits(tables: dict[str, DataFrame], directory: str, compression: str = "snappy") -> None:
    """All splits in one dataset, one folder per split, so a reader prunes by split."""
    tagged = [df.withColumn("split", F.lit(split)) for split, df in tables.items()]
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    write_parquet(everything, directory, compression=compression, partition_by=["split"])
