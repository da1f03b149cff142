"""Every operator bound to the shared tables, with the SQL that must give the same rows.

A query takes ``(spark, folder)`` and reads whole tables. ``QUERIES`` maps its name to the callable and
``ORACLES`` to the SQL, which is absent where SQL cannot express the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed precision, so that two engines' last bits do not matter. Adding 0 unifies -0."""
    return df.select(
        *(
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        )
    )


# SQL text for the hash fraction of a key, with the default seed.
def fraction_sql(key: str) -> str:
    return f"({bucket_sql(key)} / 4294967296.0)"


def bucket_sql(key: str) -> str:
    return f"(('0x' || substr(md5('42|' || {key}), 1, 8))::bigint)"


def load_all() -> None:
    from riskflow.registry import eda, engineering, judging, modelling, scalars, splitting, storage  # noqa: F401
