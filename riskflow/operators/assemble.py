"""Encoded rows: one array of category indices and one of numbers (FE-8, SCL-19, SCL-20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.scalars import quoted, to_number
from riskflow.operators.categorical import encode_vocabulary


def encode_rows(
    df: DataFrame, vocabulary: DataFrame, categorical: Sequence[str], numeric: Sequence[str]
) -> DataFrame:
    """Append ``categorical_features`` (int array) and ``numeric_features`` (double array).

    Unknown tokens are 0; numbers that are missing, do not parse or belong to an absent column are 0.0.
    """
    encoded = encode_vocabulary(df, vocabulary, categorical, "_encoded")
    indices = [F.col(f"`{c}_encoded`") for c in categorical]
    numbers = [to_number(quoted(c)) if c in df.columns else F.lit(0.0) for c in numeric]
    return encoded.withColumns(
        {
            "categorical_features": F.array(*indices) if indices else F.array().cast("array<int>"),
            "numeric_features": F.array(*numbers) if numbers else F.array().cast("array<double>"),
        }
    ).drop(*(f"{c}_encoded" for c in categorical))


def spread_array(df: DataFrame, column: str, prefix: str, size: int) -> DataFrame:
    """Append ``<prefix>0..size-1`` from an array column; positions past its end are null."""
    return df.withColumns({f"{prefix}{i}": F.get(quoted(column), F.lit(i)) for i in range(size)})


def array_mean(column: str):
    """Mean over the elements of an array column."""
    total = F.aggregate(
        F.transform(quoted(column), lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )
    return F.try_divide(total, F.size(quoted(column)).cast("double"))
