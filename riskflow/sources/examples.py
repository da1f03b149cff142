"""Model-ready examples: typed columns with a feature table beside them (SNK-13, SRC-10, JOIN-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.functions.scalars import FRACTIONAL, nan_to_null, quoted

# Example types with the Spark type that stores them and the default a reader fills in.
EXAMPLE_TYPES = {"int64": ("bigint", 0), "float": ("double", 0.0), "bytes": ("string", "")}


def example_type(field: T.StructField) -> str:
    if isinstance(field.dataType, (T.IntegralType, T.BooleanType)):
        return "int64"
    if isinstance(field.dataType, (*FRACTIONAL, T.DecimalType)):
        return "float"
    return "bytes"


def to_examples(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features cast to their example type; missing stays null, which is how an example skips it."""

    def typed(name: str) -> Column:
        field = df.schema[name]
        c = nan_to_null(quoted(name)) if isinstance(field.dataType, FRACTIONAL) else quoted(name)
        return c.cast(EXAMPLE_TYPES[example_type(field)][0]).alias(name)

    return df.select(*(typed(n) for n in features))


def feature_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(position, name, example_type)."""
    rows = [(i, n, example_type(df.schema[n])) for i, n in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, example_type string")


def write_examples(df: DataFrame, features: Sequence[str], directory: str) -> None:
    to_examples(df, features).write.mode("overwrite").parquet(f"{directory}/rows")
    feature_table(df, features).coalesce(1).write.mode("overwrite").json(f"{directory}/features")


def read_examples(spark: SparkSession, directory: str) -> DataFrame:
    """Examples with the default of its type in place of each missing feature."""
    table = spark.read.schema("position int, name string, example_type string").json(f"{directory}/features")
    listed = table.orderBy("position").collect()  # one row per feature
    unknown = [r["example_type"] for r in listed if r["example_type"] not in EXAMPLE_TYPES]
    if unknown:
        raise TypeError(f"unsupported example type: {unknown}")
    types = {r["name"]: EXAMPLE_TYPES[r["example_type"]] for r in listed}
    schema = ", ".join(f"`{n}` {t}" for n, (t, _) in types.items())
    rows = spark.read.schema(schema).parquet(f"{directory}/rows")
    return rows.select(*(F.coalesce(quoted(n), F.lit(d)).alias(n) for n, (_, d) in types.items()))
