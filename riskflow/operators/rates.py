"""A model whose fit is one aggregate: smoothed target rates by quantile bin and category, scored out of fold (HPO-2).

Every fold's counts are taken in one pass. A row is scored by the counts of all folds but its own, so cross-validation needs no
training per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.functions.scalars import number, quoted, to_text
from riskflow.operators.ordering import running_total, value_counts_long
from riskflow.session import materialise

#: Most rows of counts (folds x columns x values) that are brought to the driver as literals.
MAX_CELLS = 100_000


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: Sequence[int]) -> dict[int, dict[str, list[float]]]:
    """By number of bins and column, the least value of each bin. A value with ``below`` smaller ones among the ``n`` known
    values is in bin ``bins * below // n``, so equal values share a bin and bins hold about equally many rows."""
    counts = materialise(value_counts_long(df, {c: number(df.schema[c]) for c in columns}), "counts")
    totals = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("count").alias("n")).collect()}
    ranked = materialise(running_total(counts, ["column"], [F.col("value")], {"upto": F.col("count")}), "counts")
    n = F.element_at(F.create_map(*(F.lit(x) for pair in totals.items() for x in pair)), F.col("column")) if totals else F.lit(1)
    parts = [
        ranked.groupBy(F.lit(b).alias("bins"), "column", F.floor(F.lit(b) * (F.col("upto") - F.col("count")) / n).alias("bin"))
        .agg(F.min("value").alias("least")) for b in bins
    ]
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    found: dict[int, dict[str, list[float]]] = {b: {c: [] for c in columns} for b in bins}
    for r in union.orderBy("bins", "column", "bin").collect():  # at most bins rows a column
        found[r["bins"]][r["column"]].append(r["least"])
    return found


def quantile_bin(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges up to ``value``, less one (at least 0); null for a missing value. Nested halves: few comparisons a row."""

    def search(low: int, high: int) -> Column:
        """The bin, which is one of low .. high."""
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(value < F.lit(edges[middle]), search(low, middle - 1)).otherwise(search(middle, high))

    return F.when(value.isNotNull(), search(0, max(len(edges) - 1, 0)))


def binned(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: Sequence[int], kept: Sequence[str]) -> DataFrame:
    """``kept``, and ``bin_<bins>_<column>`` of each number for each number of bins (``bins`` itself where the number is missing),
    and texts ``value_<column>`` of each category."""
    edges = quantile_edges(df, numeric, bins)
    marks = [
        F.coalesce(quantile_bin(number(df.schema[c]), edges[b][c]), F.lit(b)).alias(f"bin_{b}_{c}") for b in bins for c in numeric
    ]
    return df.select(*(quoted(c) for c in kept), *marks, *(to_text(quoted(c)).alias(f"value_{c}") for c in categorical))


def grouped_rows(df: DataFrame, fold: str, label: str, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row for each fold, label and set of values, all that scores depend on, with the number of its rows as ``_weight``."""
    number_of = F.sum(quoted(weight)) if weight else F.count("*")
    return materialise(df.groupBy(*(quoted(c) for c in [fold, label, *columns])).agg(number_of.alias("_weight")), "grouped")


def fold_counts(df: DataFrame, fold: str, label: str, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(fold, column, value, rows, positive): one row per fold and value, combined before the shuffle. ``weight`` names the
    number of rows that a row stands for, one by default."""
    texts = [quoted(c).cast("string").alias(c) for c in columns]
    n = quoted(weight) if weight else F.lit(1)
    long = df.select(quoted(fold).alias("fold"), quoted(label).alias("_y"), n.cast("bigint").alias("_n"), *texts).unpivot(
        ["fold", "_y", "_n"], [quoted(c) for c in columns], "column", "value"
    )
    positive = F.sum(F.when(F.col("_y") == 1, F.col("_n")).otherwise(0))
    return long.groupBy("fold", "column", "value").agg(F.sum("_n").alias("rows"), positive.alias("positive"))


def bounded_counts(df: DataFrame, fold: str, label: str, columns: Sequence[str], weight: str | None = None) -> list[Row]:
    """``fold_counts`` on the driver; more than ``MAX_CELLS`` rows are an error."""
    cells = fold_counts(df, fold, label, columns, weight).limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} values by fold and column: use bins, or group rare values first")
    return cells


def out_of_fold_scores(
    df: DataFrame, fold: str, label: str, columns: Sequence[str], smoothing: float, name: str = "score", cells: list[Row] | None = None
) -> DataFrame:
    """Append ``name``: the mean over ``columns`` of the smoothed positive rate of the row's value in all other folds.

    A rate is ``(positive + smoothing * share) / (rows + smoothing)`` where ``share`` is that of all rows of the other folds,
    and ``share`` itself where no row of the other folds has the value and there is no smoothing. ``cells`` are the
    counts, where they are known. Folds are numbers from 0.
    """
    if smoothing < 0:
        raise ValueError("smoothing must not be negative")
    if cells is None:
        cells = bounded_counts(df, fold, label, columns)
    by_fold, by_value, own = {}, {}, {}
    for r in cells:
        if r["column"] == columns[0]:
            n, p = by_fold.get(r["fold"], (0, 0))
            by_fold[r["fold"]] = (n + r["rows"], p + r["positive"])
        n, p = by_value.get((r["column"], r["value"]), (0, 0))
        by_value[r["column"], r["value"]] = (n + r["rows"], p + r["positive"])
        own[r["fold"], r["column"], r["value"]] = (r["rows"], r["positive"])
    rows, positive = (sum(pair[i] for pair in by_fold.values()) for i in (0, 1))
    rates: dict[str, dict[tuple, float]] = {c: {} for c in columns}
    for f, (fn, fp) in by_fold.items():
        share = (positive - fp) / (rows - fn) if rows > fn else 0.0
        for (c, v), (n, p) in by_value.items():
            n0, p0 = own.get((f, c, v), (0, 0))
            below = n - n0 + smoothing
            rates[c][f, v] = (p - p0 + smoothing * share) / below if below else share
    whole = {c: isinstance(df.schema[c].dataType, T.IntegralType) for c in columns}
    folds = max(by_fold, default=0) + 1
    looked, kinds, scored = [], [], F.lit(0.0)
    for i, c in enumerate(columns):
        if whole[c]:  # small whole numbers: their place in an array
            values = max((int(v) for _, v in rates[c]), default=0) + 1
            table = [0.0] * (folds * values)
            for (f, v), rate in rates[c].items():
                table[f * values + int(v)] = rate
            place = quoted(fold) * F.lit(values) + quoted(c)
        else:
            table = {f"{f}|{v}": rate for (f, v), rate in rates[c].items()}
            place = F.concat(quoted(fold).cast("string"), F.lit("|"), quoted(c))
        looked.append((table, place))
        kinds.append(f"r{i} {'array<double>' if whole[c] else 'map<string,double>'}")
    tables = df.sparkSession.createDataFrame([tuple(table for table, _ in looked)], ", ".join(kinds))
    for i, ((_, place), c) in enumerate(zip(looked, columns, strict=True)):
        found = tables.select(f"r{i}").scalar()
        scored = scored + (F.get(found, place) if whole[c] else F.element_at(found, place))
    return df.withColumn(name, scored / F.lit(float(len(columns))))


def out_of_fold_error(
    df: DataFrame, fold: str, label: str, columns: Sequence[str], smoothing: float, cells: list[Row] | None = None, weight: str | None = None
) -> float:
    """Mean over the folds of the mean squared error of the scores: one job for the counts, unless known, one for the errors.

    ``weight`` names the number of rows that a row of ``df`` stands for, one by default.
    """
    if cells is None:
        cells = bounded_counts(df, fold, label, columns, weight)
    scored = out_of_fold_scores(df, fold, label, columns, smoothing, "_score", cells)
    square = F.pow(quoted(label) - F.col("_score"), F.lit(2.0))
    rows = F.when(square.isNotNull(), quoted(weight)) if weight else None
    error = F.avg(square) if weight is None else F.sum(square * rows) / F.sum(rows)
    found = [r["e"] for r in scored.groupBy(quoted(fold).alias("fold")).agg(error.alias("e")).orderBy("fold").collect()]
    return sum(found) / len(found)
