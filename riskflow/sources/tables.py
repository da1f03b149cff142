"""CSV and Parquet tables (SRC-1..4, 6, 9; SNK-1, 4..7, 9)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.config import COMPRESSION, NUMERIC_RAW_COLUMNS, TABLE_KEY, TARGET
from riskflow.functions.scalars import quoted
from riskflow.sources.csv_split import read_csv_split
from riskflow.sources.files import file_count, has_files, path_exists


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV; reads its first line only."""
    return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path).columns


def raw_schema(names: Sequence[str], types: Mapping[str, str] | None = None) -> str:
    """Fixed schema for raw columns: the given types first, then the preset numeric names, else text."""
    given = {TABLE_KEY: "bigint", **(types or {})}

    def of(name: str) -> str:
        return given.get(name) or ("double" if re.fullmatch(NUMERIC_RAW_COLUMNS, name) else "string")

    return ", ".join(f"`{n}` {of(n)}" for n in names)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    types: Mapping[str, str] | None = None,
    infer: bool = False,
    multiline: bool = False,
    missing: Sequence[str] = (),
) -> DataFrame:
    """CSV with a header and one schema for the whole file; a quote inside a quoted value is doubled.

    ``multiline`` allows line breaks inside quoted values; ranges of a file are then read by many tasks all the same, by the
    parity of their quotes (``csv_split``), but for ``infer``, which takes one task per file. ``missing`` are
    spellings of a missing value in text columns; in others whatever does not parse is missing.

    Without ``schema`` the header gives the names and ``raw_schema`` the types, so a value never
    depends on what its neighbours look like. ``infer`` costs one more pass over the file.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    if infer and schema is None:
        return _without(reader.option("inferSchema", True).csv(path), missing)
    if schema is None:
        schema = raw_schema(csv_header(spark, path), types)
    if multiline:
        return _without(read_csv_split(spark, path, schema), missing)
    return _without(reader.schema(schema).csv(path), missing)


def _without(df: DataFrame, missing: Sequence[str]) -> DataFrame:
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)] if missing else []
    return df.withColumns({c: F.when(~quoted(c).isin(list(missing)), quoted(c)) for c in text}) if text else df


def read_parquet(spark: SparkSession, directory: str) -> DataFrame:
    """Lazy scan of a folder's Parquet files; a folder without any is an error."""
    if not has_files(spark, directory, "parquet"):
        raise FileNotFoundError(f"No Parquet files found in {directory}")
    return spark.read.parquet(directory)


def read_parquet_or_empty(spark: SparkSession, directory: str, schema: T.StructType | str) -> DataFrame:
    """Scan with a known schema; a folder that is empty or missing gives no rows."""
    if not path_exists(spark, directory):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(directory)


def write_parquet(
    df: DataFrame,
    directory: str,
    rows_per_file: int | None = None,
    compression: str = COMPRESSION,
    partition_by: Sequence[str] = (),
    overwrite: bool = True,
    rebalance: bool = True,
) -> None:
    """Write Parquet files.

    Without partition columns, each task writes the rows it holds and nothing moves. With them, rows are
    first rebalanced by those columns, so that files are few and of even size: adaptive execution merges
    small values and splits a value that holds most rows. ``rebalance=False`` saves that shuffle.
    """
    absent = [c for c in partition_by if c not in df.columns]
    if absent:
        raise ValueError(f"partition columns not in the table: {absent}")
    if rows_per_file is not None and rows_per_file < 1:
        raise ValueError("rows_per_file must be at least 1")
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression)
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(directory)


def write_partitioned(
    spark: SparkSession,
    csv_path: str,
    directory: str,
    partition_by: Sequence[str] = (),
    rows_per_file: int | None = 1_000_000,
    compression: str = COMPRESSION,
    schema: T.StructType | str | None = None,
    types: Mapping[str, str] | None = None,
    multiline: bool = False,
    missing: Sequence[str] = (),
) -> int:
    """CSV to Parquet, in one folder per combination of the partition columns; returns the file count.

    Rows without a partition value are kept, in Spark's default partition.
    """
    write_parquet(read_csv(spark, csv_path, schema, types, multiline=multiline, missing=missing), directory, rows_per_file, compression, partition_by)
    return file_count(spark, directory)


def write_csv(df: DataFrame, directory: str) -> None:
    """CSV files with headers, quotes doubled, white space as it is; ``read_csv`` with ``multiline`` gives the same rows."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(directory)


def write_csv_report(df: DataFrame, directory: str) -> None:
    """A small result as one CSV with a header."""
    write_csv(df.coalesce(1), directory)


def load_split(spark: SparkSession, interim: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(identity, transactions) of a split; a table that was not prepared is empty."""
    if split not in ("train", "test"):
        raise ValueError(f"split must be 'train' or 'test', got {split!r}")
    return tuple(_load_or_empty(spark, f"{interim}/{split}/{table}") for table in ("identity", "transactions"))


def _load_or_empty(spark: SparkSession, directory: str) -> DataFrame:
    if not has_files(spark, directory, "parquet"):
        return spark.createDataFrame([], f"`{TABLE_KEY}` bigint")
    return spark.read.parquet(directory)


def binary_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """The target as integer, -1 for unknown."""
    return df.withColumn(target, F.coalesce(F.col(target).try_cast("int"), F.lit(-1)))
