"""Tables bucketed and sorted by their key, so that merging them moves no row (JOIN-1, PRJ-3)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from riskflow.operators.joins import left_join

#: Rows to a bucket; the larger side of a merge decides.
BUCKET_ROWS = 1_000_000


def bucket_count(*tables: DataFrame, rows: int = BUCKET_ROWS) -> int:
    """A power of two of buckets, enough for the largest of the counted tables; tables of one merge must share it."""
    return 1 << max(0, math.ceil(math.log2(max(max(t.count() for t in tables), 1) / rows)))


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as the catalogue's table ``name`` below ``path``, ``buckets`` files bucketed and sorted by ``key``.

    Rows are dealt to the buckets before the write, by the same hash, so a bucket is one file. This is the only time that
    they move. Replaces a table of that name. A key held by very many rows makes its bucket as large.
    """
    if key not in df.columns:
        raise ValueError(f"bucket column {key} not in the table")
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def merge_bucketed(spark: SparkSession, left: str, right: str, key: str | Sequence[str]) -> DataFrame:
    """All rows of ``left`` with the columns of ``right``: bucket by bucket, each pair in one task, nothing is shuffled.

    A side small enough to be broadcast still is, by its measured size; that moves no rows of the other either.
    """
    return left_join(spark.table(left), spark.table(right), key)
