"""Whole-table reports (AGG-1..12, AGG-16, AGG-17, AGG-5/6 value counts).

Each report is one pass over the table, however many columns it covers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.scalars import NUMERIC, is_missing, number, quoted
from riskflow.operators.columns import numeric_columns, text_columns
from riskflow.operators.ordering import SINGLE_TASK_ROWS, running_total, value_counts_long
from riskflow.session import materialise


def melt(aggregated: DataFrame, names: Sequence[str], label: str, **parts: str) -> DataFrame:
    """One wide aggregate row to one row per column; ``parts`` maps output name to column prefix."""
    entry = [
        F.struct(F.lit(n).alias(label), *(F.col(f"{prefix}{i}").alias(out) for out, prefix in parts.items()))
        for i, n in enumerate(names)
    ]
    return aggregated.select(F.explode(F.array(*entry)).alias("_entry")).select("_entry.*")


def non_null_counts(df: DataFrame) -> DataFrame:
    """(column_name, non_null_count, row_count)."""
    present = [F.count(F.when(~is_missing(f), 1)).alias(f"p{i}") for i, f in enumerate(df.schema)]
    rows = [F.count("*").alias(f"r{i}") for i in range(len(df.columns))]
    return melt(df.agg(*present, *rows), df.columns, "column_name", non_null_count="p", row_count="r")


def counts_by_target(df: DataFrame, target: str) -> DataFrame:
    """Per target value, the non-null count of every other column; rows without a target are left out."""
    others = [f for f in df.schema if f.name != target]
    return df.where(quoted(target).isNotNull()).groupBy(target).agg(*(F.count(F.when(~is_missing(f), 1)).alias(f.name) for f in others))


def group_counts(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """Row count per key combination, rows with a null key left out, sorted by key."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(name)).orderBy(*keys)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count), most frequent first, ties by value; null and NaN are no values."""
    return (
        df.where(~is_missing(df.schema[column]))
        .groupBy(quoted(column).alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """(target, count, percent of all rows). Nulls weigh in the total but get no row."""
    counts = df.groupBy(quoted(target).alias(target)).agg(F.count("*").alias("count"))
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return (
        counts.select(target, "count", (F.lit(100.0) * F.col("count") / total).alias("percent"))
        .where(quoted(target).isNotNull())
        .orderBy(target)
    )


def positive_rate(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, positives, percent positive, percent of the rest."""
    hit = F.count_if(quoted(target) == 1)
    percent = F.try_divide(F.lit(100.0) * hit, F.count("*"))
    return df.agg(
        F.count("*").alias("row_count"),
        hit.alias("positives"),
        percent.alias("positive_percent"),
        (F.lit(100.0) - percent).alias("other_percent"),
    )


def missingness(df: DataFrame) -> DataFrame:
    """(column_name, null_count, null_percent) of columns with nulls, most first."""
    missing = [F.count_if(is_missing(f)).alias(f"m{i}") for i, f in enumerate(df.schema)]
    rows = [F.count("*").alias(f"r{i}") for i in range(len(df.columns))]
    return (
        melt(df.agg(*missing, *rows), df.columns, "column_name", null_count="m", rows="r")
        .where(F.col("null_count") > 0)
        .select("column_name", "null_count", (F.lit(100.0) * F.col("null_count") / F.col("rows")).alias("null_percent"))
        .orderBy(F.desc("null_count"), "column_name")
    )


def _mean_std(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    parts = []
    for i, c in enumerate(columns):
        x = number(df.schema[c])
        parts += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}")]
    return parts


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, distinct_count), exact, null and NaN left out, all columns in one shuffle.

    A text longer than its digest is counted by its SHA-256, so that long texts are not shuffled.
    """
    values = {c: _short(F.when(~is_missing(df.schema[c]), quoted(c)).cast("string")) for c in columns}
    found = value_counts_long(df, values).groupBy("column").agg(F.count("*").alias("n"))
    named = F.explode(F.array(*(F.lit(c) for c in columns)))
    asked = df.sparkSession.range(1).select(named.alias("column"))
    return asked.join(F.broadcast(found), "column", "left").select(
        F.col("column").alias("column_name"), F.coalesce("n", F.lit(0)).cast("bigint").alias("distinct_count")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(~is_missing(df.schema[column])).select(quoted(column).alias("value")).distinct()


def _short(text: Column) -> Column:
    return F.when(F.octet_length(text) > 64, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def column_profile(df: DataFrame, free_text_threshold: int = 1000) -> DataFrame:
    """(name, kind, mean, std, categories): numeric, categorical (below the threshold) or free text.

    The first pass sketches distinct counts and settles every text column far above the threshold, so
    long free text is never shuffled. Only columns that can hold at most a few thousand values are then
    counted exactly; the sketch alone never decides.
    """
    numeric, text = numeric_columns(df), text_columns(df)
    near = [F.approx_count_distinct(quoted(c), 0.05).alias(f"near{i}") for i, c in enumerate(text)]
    first = df.agg(F.count("*").alias("_rows"), *_mean_std(df, numeric), *near).first()
    candidates = [c for i, c in enumerate(text) if first[f"near{i}"] < 2 * free_text_threshold + 10]

    categories = {}
    if candidates:
        exact = value_counts_long(df, {c: quoted(c) for c in candidates})
        bounded = (
            exact.groupBy("column")
            .agg(F.array_sort(F.collect_set("value")).alias("categories"))  # candidates are small: see above
            .where(F.size("categories") < free_text_threshold)
        )
        categories = {r["column"]: list(r["categories"]) for r in bounded.collect()}
        if free_text_threshold > 0:
            categories.update({c: [] for i, c in enumerate(text) if first[f"near{i}"] == 0})

    rows = []
    for field in df.schema:
        name = field.name
        if isinstance(field.dataType, NUMERIC):
            i = numeric.index(name)
            rows.append((name, "numeric", first[f"mean{i}"], first[f"std{i}"], None))
        elif name in categories:
            rows.append((name, "categorical", None, None, categories[name]))
        else:
            rows.append((name, "free_text", None, None, None))
    schema = "name string, kind string, mean double, std double, categories array<string>"
    return df.sparkSession.createDataFrame(rows, schema)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    fractions: Sequence[float],
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """(column, q0, q1, ...): exact quantiles with linear interpolation.

    The built-in exact percentile keeps every distinct value of a column in one task's memory. Here the
    distinct values are counted in parallel, given running totals over value ranges, and the values at
    the wanted positions picked by an aggregate.
    """
    counts = materialise(value_counts_long(df, {c: number(df.schema[c]) for c in columns}))
    totals = counts.groupBy("column").agg(F.sum("count").alias("_n"))  # one row per column
    ordered = running_total(counts, ["column"], [F.col("value")], {"_upto": F.col("count")}, single_task_rows)
    picked = ordered.join(F.broadcast(totals), "column")
    aggregates = []
    for i, q in enumerate(fractions):
        position = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.floor(position), F.ceil(position)
        aggregates += [
            F.min(F.when(F.col("_upto") > low, F.col("value"))).alias(f"_low{i}"),
            F.min(F.when(F.col("_upto") > high, F.col("value"))).alias(f"_high{i}"),
            F.max(position - low).alias(f"_part{i}"),
        ]
    return (
        picked.groupBy("column")
        .agg(*aggregates)
        .select(
            "column",
            *(
                (F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")).alias(f"q{i}")
                for i in range(len(fractions))
            ),
        )
    )


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, count, mean, std, min, p25, p50, p75, max) with exact quartiles."""
    names = list(columns) if columns is not None else numeric_columns(df)
    parts = _mean_std(df, names)
    for i, c in enumerate(names):
        x = number(df.schema[c])
        parts += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    moments = melt(df.agg(*parts), names, "column_name", count="n", mean="mean", std="std", min="lo", max="hi")
    quartiles = exact_quantiles(df, names, (0.25, 0.5, 0.75)).select(
        F.col("column").alias("column_name"), F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )
    return moments.join(F.broadcast(quartiles), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def data_quality(df: DataFrame, target: str) -> DataFrame:
    """One row: table size, columns by kind, columns with nulls, split of the target."""
    with_nulls = sum((F.when(F.count_if(is_missing(f)) > 0, 1).otherwise(0) for f in df.schema), F.lit(0))
    hit = F.count_if(quoted(target) == 1)
    percent = F.try_divide(F.lit(100.0) * hit, F.count("*"))
    return df.agg(
        F.count("*").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(text_columns(df))).alias("categorical_columns"),
        with_nulls.alias("columns_with_nulls"),
        hit.alias("positives"),
        percent.alias("positive_percent"),
        (F.lit(100.0) - percent).alias("other_percent"),
    )
