"""Samples, splits, folds, class balance and seeded order (SMP-*, SRT-5, SET-1, AGG-18)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.config import SEED, TRAIN_FRACTION
from riskflow.functions.hashing import hash_bucket, hash_fraction, hash_text
from riskflow.functions.scalars import is_missing, quoted
from riskflow.operators.joins import lookup, semi_join
from riskflow.operators.ordering import MAX_RANGES, ROWS_PER_RANGE, SINGLE_TASK_ROWS, row_positions
from riskflow.session import materialise

#: Rows of a label that a range of hashes may hold; a key with more is cut by ordering.
HOT_ROWS = 4 * ROWS_PER_RANGE


def sample_rows(df: DataFrame, key: str | Column | list, fraction: float, seed: int = SEED) -> DataFrame:
    """Rows whose hash falls below ``fraction``: the same rows in every run and plan."""
    return df.where(hash_fraction(key, seed) < fraction)


def sample_cohort(
    parents: DataFrame, children: DataFrame, key: str, fraction: float, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """A sample of parents, and the children whose key is among them."""
    chosen = sample_rows(parents, key, fraction, seed)
    return chosen, semi_join(children, chosen, key)


def split_rows(
    df: DataFrame, key: str | Column | list, fraction: float = TRAIN_FRACTION, seed: int = SEED, name: str = "set"
) -> DataFrame:
    """Append the set: ``train`` for hash values up to ``fraction``, else ``validation``."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must be between 0 and 1")
    return df.withColumn(
        name, F.when(hash_fraction(key, seed) <= fraction, F.lit("train")).otherwise(F.lit("validation"))
    )


def holdout_period(fraction: float) -> int:
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must be between 0 and 1")
    return max(2, round(1.0 / fraction))


def is_holdout(key: str | Column | list, fraction: float, seed: int = SEED) -> Column:
    """True for one key in ``holdout_period(fraction)``."""
    return F.pmod(hash_bucket(key, seed), F.lit(holdout_period(fraction))) == 0


def undersample_negatives(df: DataFrame, target: str, key: str | Column | list, seed: int = SEED) -> DataFrame:
    """All positives and a hash sample of about as many negatives; all of them when they are fewer."""
    t = quoted(target)
    counts = df.agg(F.count_if(t == 1).alias("positive"), F.count_if(t == 0).alias("negative")).first()
    fraction = min(1.0, counts["positive"] / counts["negative"]) if counts["negative"] else 1.0
    # One filter over one scan equals the union of the two classes.
    return df.where((t == 1) | ((t == 0) & (hash_fraction(key, seed) < fraction)))


def stratified_folds(
    df: DataFrame,
    label: str,
    key: str,
    folds: int = 5,
    seed: int = SEED,
    name: str = "fold",
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Exact folds: rows of each label in hash order are dealt out in turn, sizes differ by at most one."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    hashed = df.withColumn("_hash", hash_text(key, seed))
    fold = F.pmod(F.col("_position") - 1, F.lit(folds)).cast("int").alias(name)
    kept = [quoted(c) for c in df.columns]
    rows = df.count()
    if rows > single_task_rows:
        # The hash spreads the rows evenly, so ranges of it need no sample, and its counts give each its place in the order.
        table = materialise(df, "folded")
        ranges = min(math.ceil(rows / min(single_task_rows, ROWS_PER_RANGE)), MAX_RANGES)
        ranged = table.withColumns({"_hash": F.unhex(hash_text(key, seed)), "_range": F.floor(hash_fraction(key, seed) * ranges).cast("int")})
        counts = materialise(ranged.groupBy(quoted(label).alias("_label"), F.col("_range").alias("_of")).agg(F.count("*").alias("_rows")), "ranges")
        if counts.agg(F.max("_rows")).first()[0] <= max(HOT_ROWS, 4 * rows / ranges):
            earlier = Window.partitionBy("_label").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
            before = counts.select("_label", "_of", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
            inside = Window.partitionBy(quoted(label), "_range").orderBy("_hash", quoted(key))
            numbered = ranged.withColumn("_inside", F.row_number().over(inside))
            same = quoted(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_of"))  # one row a label and range
            return numbered.join(F.broadcast(before), same).withColumn("_position", F.col("_before") + F.col("_inside")).select(*kept, fold)
        hashed = materialise(table.withColumn("_hash", hash_text(key, seed)), "hashed")  # a key that holds many rows
    placed = row_positions(hashed, [label], [F.col("_hash"), quoted(key)], "_position", single_task_rows)
    return placed.select(*kept, fold)


def hashed_folds(df: DataFrame, key: str | Column | list, folds: int = 5, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Folds by hash: no shuffle, every label close to evenly spread when it has many rows."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    return df.withColumn(name, F.pmod(hash_bucket(key, seed), F.lit(folds)).cast("int"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, count, weight) with balanced weights ``n / (classes * count)``."""
    counts = df.where(~is_missing(df.schema[label])).groupBy(quoted(label).alias("label")).agg(F.count("*").alias("count"))
    counts = materialise(counts, "classes")  # one scan of the rows, one row per class
    totals = counts.agg(F.sum("count").alias("n"), F.count("*").alias("k")).first()
    n, k = totals["n"] or 0, totals["k"]
    return counts.withColumn("weight", F.lit(float(n)) / (F.lit(k) * F.col("count")))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Append the balanced weight of each row's class, null without a class; any number of classes."""
    weights = materialise(class_weights(df, label), "weights")
    found = lookup(df, quoted(label), weights, "label", "weight", name, F.lit(None).cast("double"), "count")
    return found.select(*(quoted(c) for c in df.columns if c != name), name)


def shuffled(df: DataFrame, key: str | Column | list, seed: int = SEED) -> DataFrame:
    """Seeded random order; followed by ``limit`` it is planned as a top-k and sorts nothing globally."""
    columns = [quoted(c) for c in df.columns]
    return df.withColumn("_order", hash_text(key, seed)).orderBy("_order", *columns).drop("_order")


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows found; reads as few partitions as it can."""
    return df.limit(rows)
