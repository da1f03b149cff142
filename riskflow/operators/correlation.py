"""Correlation matrices and correlation with a target (AGG-13..15)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.scalars import number
from riskflow.operators.comoments import comoments, paired_comoments
from riskflow.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup
from riskflow.operators.ordering import SINGLE_TASK_ROWS, running_total
from riskflow.session import materialise


def _table(df: DataFrame, pairs: Sequence[tuple[str, str]], found: np.ndarray, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(column_a, column_b, correlation) of some entries of a matrix; NaN becomes null."""
    at_a, at_b = ({c: i for i, c in enumerate(side)} for side in (rows, columns))
    values = [(a, b, float(found[at_a[a], at_b[b]])) for a, b in pairs]
    listed = [(a, b, None if math.isnan(r) else r) for a, b, r in values]
    return df.sparkSession.createDataFrame(listed, "column_a string, column_b string, correlation double")


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle with diagonal, in one scan; each pair uses the rows where both values are present."""
    pairs = list(combinations_with_replacement(columns, 2))
    found = comoments(df, columns).correlation() if columns else np.zeros((0, 0))
    return _table(df, pairs, found, columns, columns)


def spearman_matrix(df: DataFrame, columns: Sequence[str], single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Pearson correlation of average ranks, upper triangle with diagonal; each pair is ranked within its complete rows.

    One grouped pass counts each distinct value of each column: in all rows, and in the rows that have each of the columns
    with missing values. Running sums of those counts are the ranks of the value beside any other column. Each column's ranks are
    looked up in place: those that fit are broadcast, only a column with too many values moves the rows, and all pairs come
    from one pass over the rows' ranks. A value shared by many rows is ranked once.
    """
    values = {c: number(df.schema[c]) for c in columns}
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    pairs = list(combinations_with_replacement(columns, 2))
    if not columns:
        return _table(df, pairs, np.zeros((0, 0)), columns, columns)
    narrow = materialise(df.select(*(values[c].alias(names[c]) for c in columns)), "ranked")
    missing = narrow.agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in names.values())).first()
    holed = [n for n in names.values() if missing[n]]
    present = [F.col(n).isNotNull().alias(f"has_{n}") for n in holed]
    long = narrow.select(*present, *(F.col(n) for n in names.values())).unpivot(
        [f"has_{n}" for n in holed], [F.col(n) for n in names.values()], "column", "value"
    ).where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(
        F.count("*").alias("n_all"), *(F.count_if(F.col(f"has_{n}")).alias(f"n_{n}") for n in holed)
    )
    kinds = ["all", *holed]
    ranked = running_total(materialise(counts, "ranks"), ["column"], [F.col("value")], {f"upto_{k}": F.col(f"n_{k}") for k in kinds}, single_task_rows)
    ranks = ranked.select(
        "column", "value", F.col("n_all").alias("count"),
        F.array(*((F.col(f"upto_{k}") - F.col(f"n_{k}") + (F.col(f"n_{k}") + 1) / F.lit(2.0)) for k in kinds)).alias("ranks"),
    )
    ranks = materialise(ranks, "ranks")
    numbers = {r["column"]: r["count"] for r in ranks.groupBy("column").count().collect()}  # one row a column
    # Per row: for each column the ranks of its value beside every other column; none where it is missing.
    rows, nothing = narrow, F.lit(None).cast("array<double>")
    for n in sorted(names.values(), key=lambda n: -numbers.get(n, 0)):  # the widest first, before rows carry ranks
        fits = numbers.get(n, 0) <= BROADCAST_ROWS and numbers.get(n, 0) * (16 + 24 * len(kinds)) <= BROADCAST_BYTES
        rows = lookup(rows, n, ranks.where(F.col("column") == n), "value", "ranks", f"by_{n}", nothing, "count", fits)
    beside = [kinds.index(n) if n in holed else 0 for n in names.values()]

    def of(name: str) -> Column:
        own = F.col(f"by_{name}")
        empty = F.array_repeat(F.lit(None).cast("double"), len(columns))
        return F.when(own.isNotNull(), F.array(*(F.get(own, F.lit(k)) for k in beside))).otherwise(empty)

    matrices = rows.select(F.array(*(of(n) for n in names.values())).alias("matrix"))
    result = paired_comoments(matrices, "matrix", len(columns)).correlation()
    return _table(df, pairs, result, columns, columns)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One pair, ranked within the rows where both values are present."""
    found = spearman_matrix(df, list(dict.fromkeys([a, b])))
    return found.where((F.col("column_a") == a) & (F.col("column_b") == b))


def target_correlation(df: DataFrame, target: str, columns: Sequence[str], top: int = 15) -> DataFrame:
    """(column_name, correlation) with the target, highest first, in one scan."""
    found = comoments(df, columns, [target]).correlation() if columns else np.zeros((0, 1))
    return (
        _table(df, [(c, target) for c in columns], found, columns, [target])
        .select(F.col("column_a").alias("column_name"), "correlation")
        .orderBy(F.desc_nulls_last("correlation"), "column_name")
        .limit(top)
    )
