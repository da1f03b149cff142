"""Small fitted tables as JSON: category mappings, scaling parameters, run settings (SRC-8; SNK-10, 11, 14)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAPPING_DOCUMENT = (
    "column string, mapping map<string, struct<count: bigint, cumulative_count: bigint, "
    "cumulative_percentage: double, category: string>>"
)
VALUES_PER_DOCUMENT = 50_000


def write_mapping_json(mapping: DataFrame, directory: str, values_per_document: int = VALUES_PER_DOCUMENT) -> None:
    """JSON documents ``{"column": c, "mapping": {value: {...}}}``, one per column.

    A column with more values than one document should hold is spread over several documents of the
    same form, so no task ever builds a document of unbounded size.
    """
    sizes = mapping.groupBy("column").agg(F.ceil(F.count("*") / F.lit(values_per_document)).alias("_parts"))
    entry = F.struct("value", F.struct("count", "cumulative_count", "cumulative_percentage", "category"))
    documents = (
        mapping.join(F.broadcast(sizes), "column")  # one row per column
        .withColumn("_part", F.pmod(F.xxhash64("value"), F.col("_parts")))
        .groupBy("column", "_part")
        .agg(F.map_from_entries(F.collect_list(entry)).alias("mapping"))
    )
    documents.select("column", "mapping").write.mode("overwrite").json(directory)


def read_mapping_json(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(column, value, count, cumulative_count, cumulative_percentage, category) of mapping documents."""
    documents = spark.read.schema(MAPPING_DOCUMENT).json(paths if isinstance(paths, str) else list(paths))
    return documents.select("column", F.explode("mapping").alias("value", "_entry")).select("column", "value", "_entry.*")


def write_mapping(mapping: DataFrame, directory: str) -> None:
    mapping.write.mode("overwrite").parquet(directory)


def read_mapping(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(directory)


def write_scaling(table: DataFrame, directory: str) -> None:
    """(column, mean, std) rows, one JSON line per column."""
    table.coalesce(1).write.mode("overwrite").json(directory)


def read_scaling(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema("column string, mean double, std double").json(directory)


def write_vocabulary(vocabulary: DataFrame, features: Sequence[str], directory: str) -> None:
    """What scoring needs of a training run: tokens with their indexes as Parquet; feature order and cardinalities as JSON."""
    spark = vocabulary.sparkSession
    vocabulary.write.mode("overwrite").partitionBy("column").parquet(f"{directory}/tokens")
    sizes = vocabulary.groupBy("column").agg((F.max("index") + 1).alias("cardinality"))
    known = {r["column"]: r["cardinality"] for r in sizes.collect()}  # one row per column
    rows = [(i, c, known.get(c)) for i, c in enumerate(features)]
    schema = "position int, feature string, cardinality int"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(f"{directory}/features")


def read_vocabulary(spark: SparkSession, directory: str) -> tuple[DataFrame, list[str], dict[str, int]]:
    """(vocabulary, feature order, cardinality by categorical feature) as written."""
    tokens = spark.read.schema("token string, index int, count bigint, column string").parquet(f"{directory}/tokens")
    found = spark.read.schema("position int, feature string, cardinality int").json(f"{directory}/features").orderBy("position").collect()
    sizes = {r["feature"]: r["cardinality"] for r in found if r["cardinality"] is not None}
    return tokens.select("column", "token", "index", "count"), [r["feature"] for r in found], sizes


def write_settings(spark: SparkSession, settings: dict[str, Any], directory: str) -> None:
    """Named run settings, such as feature order and parameters, as (name, value) JSON lines."""
    rows = [(name, json.dumps(value)) for name, value in settings.items()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(directory)


def read_settings(spark: SparkSession, directory: str) -> dict[str, Any]:
    rows = spark.read.schema("name string, value string").json(directory).collect()
    return {r["name"]: json.loads(r["value"]) for r in rows}
