"""Scalar helpers shared by the operators (SCL-1..21, PRJ-5..8, PRJ-11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONAL = (T.DoubleType, T.FloatType)
NUMERIC = (T.NumericType, T.BooleanType)


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(column: str | Column) -> Column:
    """NaN counts as missing everywhere; Spark aggregates would otherwise return NaN."""
    c = _column(column)
    return F.when(~F.isnan(c), c)


def number(field: T.StructField) -> Column:
    """A numeric column ready for statistics: booleans as 0/1, NaN as null, always double."""
    c = quoted(field.name)
    if isinstance(field.dataType, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(field.dataType, FRACTIONAL):
        return nan_to_null(c).cast("double")
    return c.cast("double")


def is_missing(field: T.StructField) -> Column:
    c = quoted(field.name)
    if isinstance(field.dataType, FRACTIONAL):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def to_text(column: str | Column, null_token: str | None = "nan") -> Column:
    """Text form of any value. Missing becomes ``null_token``; ``None`` keeps SQL null."""
    text = _column(column).cast("string")
    return text if null_token is None else F.coalesce(text, F.lit(null_token))


def value_text(field: T.StructField, null_token: str | None = "nan") -> Column:
    """Text of a column's values in one spelling: NaN is missing, a whole number has no fraction whatever its type."""
    c = quoted(field.name)
    if not isinstance(field.dataType, FRACTIONAL):
        return to_text(c, null_token)
    c = nan_to_null(c)
    whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
    return to_text(F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string")), null_token)


def to_number(column: str | Column, default: float | None = 0.0) -> Column:
    """Text or number to double; what does not parse, and NaN, becomes ``default``."""
    parsed = nan_to_null(_column(column).try_cast("double"))
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def to_integer(column: str | Column) -> Column:
    """Label text to integer, null when it does not parse."""
    return _column(column).try_cast("int")


def standardise(column: str | Column, mean: float | None, std: float | None) -> Column:
    """``(x - mean) / std``; null when the deviation is zero or unknown."""
    return F.try_divide(_column(column) - F.lit(mean).cast("double"), F.lit(std).cast("double"))


def sigmoid(column: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_column(column)))


def clip(column: str | Column, low: float, high: float) -> Column:
    return F.least(F.greatest(_column(column), F.lit(low)), F.lit(high))


def bin_edges(n_bins: int) -> list[float]:
    """Equal-width edges over [0, 1]: ``i * (1 / n)``, the last one exactly 1."""
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def equal_width_bin(column: str | Column, n_bins: int) -> Column:
    """Index of the left-closed bin ``[e_i, e_i+1)``; 1.0 gets ``n_bins`` and below 0 gets -1.

    Comparing with the edges, rather than multiplying and flooring, keeps a value just under an
    inexact edge such as 0.30000000000000004 on the right side of it.
    """
    c = _column(column)
    passed = sum(((c >= F.lit(edge)).cast("int") for edge in bin_edges(n_bins)), F.lit(0))
    return passed - F.lit(1)


def at_least(column: str | Column, threshold: float) -> Column:
    return (_column(column) >= F.lit(threshold)).cast("int")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0 when undefined, as precision and recall are."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def underscored(column: str | Column) -> Column:
    """``-`` replaced by ``_``."""
    return F.replace(_column(column), F.lit("-"), F.lit("_"))


def matches(column: str | Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search."""
    return _column(column).rlike(f"(?i){pattern}")


def extract_integer(column: str | Column, pattern: str, group: int = 1) -> Column:
    """Integer held by a group of the pattern; null when it does not match."""
    return F.regexp_extract(_column(column), pattern, group).try_cast("int")


def suffix_number(column: str | Column, prefix: str, separator: str = "_") -> Column:
    """Integer after the separator of names with the given prefix (``id_12`` gives 12), else null."""
    c = _column(column)
    return F.when(
        c.startswith(prefix), F.try_element_at(F.split(c, separator), F.lit(2)).try_cast("int")
    )


def file_suffix(column: str | Column) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(_column(column), r"(\.[^./]+)$", 1))


def zero_padded(column: str | Column, width: int = 6) -> Column:
    return F.format_string(f"%0{width}d", _column(column))
