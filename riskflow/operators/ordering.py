"""Running totals and positions over a whole ordered table, without an all-rows window task.

``Window.orderBy`` without ``partitionBy`` (or partitioned by a handful of column names or labels)
moves every row of a group to one task. Up to a counted number of rows that is the cheapest plan. Past
it the table is range-partitioned, each range is summed on its own, and the totals of the ranges before
it are added.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.scalars import quoted
from riskflow.session import materialise

SINGLE_TASK_ROWS = 1_000_000
ROWS_PER_RANGE = 500_000
MAX_RANGES = 10_000


def running_total(
    table: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    amounts: dict[str, Column],
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Append, per group and in the given order, the inclusive running sum of each amount.

    ``table`` must be a file scan or a materialised table: it is counted first, and rows equal under
    ``order`` are told apart by where they are stored. ``group`` must be columns with few values (column
    names, labels, sets); they may not be null.
    """
    rows = table.count()
    if rows <= single_task_rows:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return table.select("*", *(F.sum(a).over(window).alias(n) for n, a in amounts.items()))

    ranges = min(max(2, math.ceil(rows / ROWS_PER_RANGE)), MAX_RANGES)
    # The row id lets equal rows be cut into several ranges; the written copy keeps the cut fixed.
    placed = materialise(
        table.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(ranges, *(F.col(g) for g in group), *order, F.col("_tie"))
        .withColumn("_range", F.spark_partition_id())
    )
    inside = (
        Window.partitionBy("_range", *group)
        .orderBy(*order, F.col("_tie"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("_range", *group)
        .agg(*(F.sum(a).alias(f"_sum_{n}") for n, a in amounts.items()))
        .select("_range", *group, *(F.sum(f"_sum_{n}").over(earlier).alias(f"_before_{n}") for n in amounts))
    )
    zero = F.lit(0)
    return (
        placed.select("*", *(F.sum(a).over(inside).alias(f"_inside_{n}") for n, a in amounts.items()))
        .join(before, ["_range", *group], "left")  # both sides are already partitioned this way
        .select(
            *(F.col(c) for c in table.columns),
            *((F.col(f"_inside_{n}") + F.coalesce(f"_before_{n}", zero)).alias(n) for n in amounts),
        )
    )


def row_positions(
    table: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Append the 1-based position of each row within its group."""
    return running_total(table, group, order, {name: F.lit(1).cast("bigint")}, single_task_rows)


def value_counts_long(df: DataFrame, values: dict[str, Column], column: str = "column", value: str = "value") -> DataFrame:
    """One row per (column, distinct non-null value) with its count, in one scan and one shuffle.

    The counts are combined before the shuffle, so a value held by most rows costs one row per task.
    """
    names = list(values)
    return (
        df.select(*(values[n].alias(n) for n in names))
        .unpivot([], [quoted(n) for n in names], column, value)
        .where(F.col(value).isNotNull())
        .groupBy(column, value)
        .agg(F.count("*").alias("count"))
    )


def average_ranks(
    df: DataFrame, values: dict[str, Column], single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Table (column, value, count, average_rank): 1-based ranks with ties sharing their mean."""
    counts = materialise(value_counts_long(df, values))
    ranked = running_total(counts, ["column"], [F.col("value")], {"_upto": F.col("count")}, single_task_rows)
    return ranked.select(
        "column",
        "value",
        "count",
        (F.col("_upto") - F.col("count") + (F.col("count") + 1) / F.lit(2.0)).alias("average_rank"),
    )
