"""Column selection, renames, casts and defaults (PRJ-1..14, SET-4)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.functions.scalars import FRACTIONAL, NUMERIC, nan_to_null, quoted, to_number, value_text


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skipped = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in skipped]


def columns_of_type(df: DataFrame, *types: type[T.DataType], exclude: Iterable[str] = ()) -> list[str]:
    skipped = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, types) and f.name not in skipped]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_of_type(df, T.StringType, exclude=exclude)


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def columns_numbered(df: DataFrame, prefix: str, above: int) -> list[str]:
    """Columns named ``prefix<number>`` whose number is greater than ``above``."""
    found = ((c, c.removeprefix(prefix)) for c in df.columns if c.startswith(prefix))
    return [c for c, number in found if number.isdigit() and int(number) > above]


def feature_order(available: Iterable[str], used: Sequence[str], categorical: Iterable[str]) -> tuple[list[str], list[str]]:
    """(categorical, numeric) features in the order of ``used``, limited to those available."""
    present, as_category = set(available), set(categorical)
    kept = [name for name in used if name in present]
    return [n for n in kept if n in as_category], [n for n in kept if n not in as_category]


def select_features(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """Ordered projection; absent features are an error."""
    names = [*features, *([target] if target else [])]
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {absent}")
    return df.select(*(quoted(n) for n in names))


def underscore_names(df: DataFrame) -> DataFrame:
    """``-`` in column names becomes ``_``."""
    return df.toDF(*(c.replace("-", "_") for c in df.columns))


def categories_to_text(df: DataFrame, columns: Iterable[str], null_token: str | None = "nan") -> DataFrame:
    """Cast the given columns, where present, to text."""
    return df.withColumns({c: value_text(df.schema[c], null_token) for c in columns if c in df.columns})


def add_target_if_absent(df: DataFrame, target: str, value: int = -1) -> DataFrame:
    return df if target in df.columns else df.withColumn(target, F.lit(value))


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add each column that the table lacks, holding its default."""
    return df.withColumns({n: d for n, d in defaults.items() if n not in df.columns})


def coerce_numeric(df: DataFrame, columns: Iterable[str], default: float | None = 0.0) -> DataFrame:
    return df.withColumns({c: to_number(quoted(c), default) for c in columns})


def fill_by_type(df: DataFrame, text: str = "", number: float = 0) -> DataFrame:
    """Missing text becomes ``""`` and missing numbers 0."""
    def filled(field: T.StructField) -> Column:
        c = quoted(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.coalesce(c, F.lit(text)).alias(field.name)
        if isinstance(field.dataType, FRACTIONAL):
            return F.coalesce(nan_to_null(c), F.lit(number).cast(field.dataType)).alias(field.name)
        if isinstance(field.dataType, T.NumericType):
            return F.coalesce(c, F.lit(number).cast(field.dataType)).alias(field.name)
        return c

    return df.select(*(filled(f) for f in df.schema))


def nan_as_null(df: DataFrame) -> DataFrame:
    """Every NaN in a fractional column becomes null."""
    columns = columns_of_type(df, *FRACTIONAL)
    return df.withColumns({c: nan_to_null(quoted(c)) for c in columns}) if columns else df


def require_key(df: DataFrame, key: str) -> DataFrame:
    """Fail the job that meets a row without a key; the check is part of the plan, not a job of its own."""
    message = F.lit(f"null in key column {key}")
    return df.withColumn(key, F.coalesce(quoted(key), F.raise_error(message).cast(df.schema[key].dataType)))


def describe_schema(df: DataFrame, table: str) -> DataFrame:
    """(table_name, position, column_name, data_type, row_count) of a table."""
    described = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
            )
            for i, f in enumerate(df.schema, start=1)
        )
    )
    return (
        df.agg(F.count("*").alias("row_count"))
        .select(F.lit(table).alias("table_name"), F.explode(described).alias("_field"), "row_count")
        .select("table_name", "_field.*", "row_count")
    )
