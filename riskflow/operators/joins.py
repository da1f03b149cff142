"""Left join of two tables on a key, semi join, and dictionary lookups (JOIN-1..6, FLT-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.scalars import quoted

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
HOT_VALUES = 20_000


def left_join(
    left: DataFrame, right: DataFrame, key: str | Sequence[str], right_unique: bool = True
) -> DataFrame:
    """All left rows; the right columns that the left does not have, after the left columns.

    The join strategy is left to the optimiser: adaptive execution picks broadcast or sort-merge by
    measured size and splits left partitions that a frequent key makes large. In an outer join it cannot
    split the right side, so a right table that may repeat a key often should come with
    ``right_unique=False``: matches are then found by an inner join, where both sides can be split, and
    left rows without a match are added.
    """
    keys = [key] if isinstance(key, str) else list(key)
    for side, name in ((left, "left"), (right, "right")):
        absent = [k for k in keys if k not in side.columns]
        if absent:
            raise ValueError(f"join key {absent} not in the {name} table")
    added = [c for c in right.columns if c not in left.columns]
    wanted = right.select(*keys, *added)
    if right_unique:
        return left.join(wanted, keys, "left").select(*left.columns, *added)
    matched = left.join(wanted, keys, "inner").select(*left.columns, *added)
    alone = left.join(right.select(*keys).distinct(), keys, "left_anti")
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in added]
    return matched.unionByName(alone.select(*left.columns, *nothing))


def semi_join(df: DataFrame, kept: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key appears in ``kept``.

    The kept keys are made distinct first: that combines a frequent key before the shuffle, and leaves
    the keys partitioned as the join wants them, so it adds no shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(kept.select(*keys).distinct(), keys, "left_semi")


def small_enough(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a lookup table fits the broadcast bounds; measured, not estimated."""
    widths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.lit(16) for c in table.columns]
    found = table.agg(F.count("*").alias("rows"), F.sum(sum(widths[1:], widths[0])).alias("bytes")).first()
    return found["rows"] <= rows and (found["bytes"] or 0) <= size


def lookup(
    df: DataFrame,
    column: str | Column,
    table: DataFrame,
    value: str,
    result: str,
    name: str,
    default: Column,
    weight: str | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Append ``name``: the ``result`` that ``table`` holds for the column's value, else ``default``.

    ``table`` must be materialised and unique on ``value``; ``fits`` passes on an earlier measurement. Within the broadcast bounds the lookup moves
    no rows of ``df``. Beyond them the most frequent values (by ``weight``) are still broadcast, and
    only the rest is shuffled; rows already answered, and rows without a value, get a salt of their own
    that matches nothing, so they spread over all tasks whatever their value.
    """
    key = F.col(column) if isinstance(column, str) else column
    entries = table.select(
        F.col(value).alias("_key"), F.col(result).alias("_found"), *([F.col(weight).alias("_weight")] if weight else [])
    )
    answer = F.coalesce(F.col("_found"), default).alias(name)
    kept = [quoted(c) for c in df.columns if c != name]
    keyed = df.withColumn("_key", key)
    if small_enough(entries) if fits is None else fits:
        return keyed.join(F.broadcast(entries.select("_key", "_found")), "_key", "left").select(*kept, answer)

    hot = entries.orderBy(F.desc("_weight"), "_key").limit(HOT_VALUES) if weight else entries.limit(0)
    hot = hot.select("_key", F.col("_found").alias("_hot"), F.lit(True).alias("_is_hot"))
    if small_enough(hot, HOT_VALUES):
        keyed = keyed.join(F.broadcast(hot), "_key", "left")
    else:  # a few very long values: not worth sending to every executor
        keyed = keyed.withColumn("_hot", F.lit(None).cast(entries.schema["_found"].dataType)).withColumn(
            "_is_hot", F.lit(None).cast("boolean")
        )
    mixed = F.xxhash64(*(quoted(c) for c in df.columns))
    spread = F.when(mixed == 0, F.lit(1).cast("bigint")).otherwise(mixed)
    settled = F.col("_is_hot").isNotNull() | F.col("_key").isNull()
    keyed = keyed.withColumn("_salt", F.when(settled, spread).otherwise(F.lit(0).cast("bigint")))
    cold = entries.select("_key", "_found", F.lit(0).cast("bigint").alias("_salt"))
    return keyed.join(cold.hint("merge"), ["_key", "_salt"], "left").select(
        *kept, F.coalesce(F.col("_hot"), F.col("_found"), default).alias(name)
    )
