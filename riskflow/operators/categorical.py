"""Category grouping by cumulative share, and vocabularies (FE-1, 2, 5, 6, 7, 9; JOIN-4, 5; WIN-1, 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.config import CATEGORY_SHARE, NULL_TOKEN, OTHER
from riskflow.functions.scalars import quoted, value_text
from riskflow.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup
from riskflow.operators.ordering import SINGLE_TASK_ROWS, row_positions, running_total, value_counts_long
from riskflow.session import materialise

LITERAL_VALUES = 500


def fit_category_mapping(
    df: DataFrame,
    columns: Sequence[str],
    share: float = CATEGORY_SHARE,
    other: str = OTHER,
    null_token: str | None = NULL_TOKEN,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """(column, value, count, cumulative_count, cumulative_percentage, category) for all columns at once.

    Values are taken most frequent first, ties by value. A value keeps its own name while the share
    covered up to and including it stays within ``share`` percent; later ones become ``other``.
    """
    counts = materialise(value_counts_long(df, {c: value_text(df.schema[c], null_token) for c in columns}))
    totals = counts.groupBy("column").agg(F.sum("count").alias("_total"))  # one row per column
    running = running_total(
        counts, ["column"], [F.desc("count"), F.asc("value")], {"cumulative_count": F.col("count")}, single_task_rows
    )
    percentage = F.col("cumulative_count") / F.col("_total") * 100
    mapping = (
        running.join(F.broadcast(totals), "column")
        .withColumn("cumulative_percentage", percentage)
        .select(
            "column",
            "value",
            "count",
            "cumulative_count",
            "cumulative_percentage",
            F.when(F.col("cumulative_percentage") > share, F.lit(other)).otherwise(F.col("value")).alias("category"),
        )
    )
    return materialise(mapping)


def apply_category_mapping(
    df: DataFrame,
    mapping: DataFrame,
    columns: Sequence[str],
    other: str = OTHER,
    null_token: str | None = NULL_TOKEN,
    literal_values: int = LITERAL_VALUES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace each value by its category; values the mapping does not hold become ``other``.

    Entries that lead to ``other`` anyway are dropped first. What is left is usually a short list of
    values that keep their name: that is a set test on literals, which needs no join and also runs on a
    stream. Longer or renaming mappings go through a lookup join.
    """
    useful = mapping.where((F.col("category") != other) & F.col("column").isin(list(columns)))
    size = F.sum(F.octet_length("value") + F.octet_length("category") + F.lit(32))
    measured = useful.groupBy("column").agg(
        F.count("*").alias("n"), size.alias("bytes"), F.count_if(F.col("value") != F.col("category")).alias("renamed")
    )
    found = {r["column"]: r for r in measured.collect()}  # one row per column
    literal = [
        c for c, r in found.items() if r["n"] <= literal_values and r["renamed"] == 0 and r["bytes"] <= 1_000_000
    ]
    kept: dict[str, list[str]] = {c: [] for c in columns if c not in found}
    if literal:
        rows = useful.where(F.col("column").isin(literal)).groupBy("column").agg(F.collect_list("value").alias("v"))
        kept.update({r["column"]: sorted(r["v"]) for r in rows.collect()})

    replaced = {}
    for c, values in kept.items():
        text = value_text(df.schema[c], null_token)
        replaced[c] = F.when(text.isin(values), text).otherwise(F.lit(other)) if values else F.lit(other)
    result = df.withColumns(replaced) if replaced else df
    for c in columns:
        if c in kept:
            continue
        table = useful.where(F.col("column") == c)
        fits = found[c]["n"] <= broadcast_rows and found[c]["bytes"] <= BROADCAST_BYTES
        weight = "count" if "count" in mapping.columns else None
        result = lookup(
            result, value_text(df.schema[c], null_token), table, "value", "category", c, F.lit(other), weight, fits
        ).select(*(quoted(n) for n in df.columns))
    return result


def fit_vocabulary(
    df: DataFrame, columns: Sequence[str], single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """(column, token, index, count): index 1 is the most frequent token, ties by later text first.

    Index 0 is left for null and for tokens not seen here. Fit on training rows only.
    """
    counts = materialise(value_counts_long(df, {c: value_text(df.schema[c], None) for c in columns}, value="token"))
    placed = row_positions(counts, ["column"], [F.desc("count"), F.desc("token")], "index", single_task_rows)
    return materialise(placed.select("column", "token", F.col("index").cast("int").alias("index"), "count"))


def cardinalities(vocabulary: DataFrame) -> DataFrame:
    """(column, cardinality): tokens plus the slot for unknown ones."""
    return vocabulary.groupBy("column").agg((F.max("index") + 1).alias("cardinality"))


def encode_vocabulary(
    df: DataFrame,
    vocabulary: DataFrame,
    columns: Sequence[str],
    suffix: str = "_index",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Append ``<column><suffix>``: the token's index, 0 for null or unknown, or when the column is absent."""
    size = F.sum(F.octet_length("token") + F.lit(32))
    measured = vocabulary.groupBy("column").agg(F.count("*").alias("n"), size.alias("bytes"))
    found = {r["column"]: r for r in measured.collect()}  # one row per column
    result = df
    for c in columns:
        if c not in df.columns or c not in found:
            result = result.withColumn(f"{c}{suffix}", F.lit(0))
            continue
        fits = found[c]["n"] <= broadcast_rows and found[c]["bytes"] <= BROADCAST_BYTES
        table = vocabulary.where(F.col("column") == c)
        result = lookup(
            result, value_text(df.schema[c], None), table, "token", "index", f"{c}{suffix}", F.lit(0), "count", fits
        )
    return result
