"""Contextual row vectors: every token takes in the other tokens of its row (FE-11, FE-13).

One step of message passing. The weight between two tokens is their positive pointwise mutual information, from how often they
stand in one row. A token's vector in a row is its own plus the weighted vectors of the row's other tokens; the row's
vector is the mean. Rows with the same tokens have the same vector, which is computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.scalars import quoted
from riskflow.operators.embeddings import RowEncoder
from riskflow.session import materialise


def token_pairs(rows: DataFrame, tokens: str) -> DataFrame:
    """(a, b, weight) for ordered pairs of different tokens: max(0, ln(rows x together / (rows with a x rows with b))).

    ``tokens`` is an array of (column, value). Rows with the same tokens are counted before their pairs are made, so a
    frequent row costs its pairs once. Pairs of weight 0 are left out.
    """
    sets = materialise(rows.groupBy(quoted(tokens).alias("tokens")).agg(F.count("*").alias("n")), "sets")
    total = sets.agg(F.sum("n").alias("n"))
    alone = sets.select(F.explode("tokens").alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n"))
    pairs = (
        sets.select(F.explode("tokens").alias("a"), "tokens", "n").select("a", F.explode("tokens").alias("b"), "n")
        .where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("both"))
    )
    counted = pairs.join(alone.select(F.col("t").alias("a"), F.col("n").alias("n_a")), "a").join(
        alone.select(F.col("t").alias("b"), F.col("n").alias("n_b")), "b"
    )
    product = F.col("n_a").cast("double") * F.col("n_b")
    weight = F.ln(total.scalar().cast("double") * F.col("both") / product)
    return materialise(counted.select("a", "b", weight.alias("weight")).where("weight > 0"), "pairs")


def context_vectors(rows: DataFrame, tokens: str, pairs: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """(tokens, vector): for each distinct array of tokens the mean of its tokens' contextual vectors.

    ``vectors`` has (column, value, vector). Unknown tokens count as zero, and so do unknown pairs.
    """
    sets = materialise(
        rows.select(quoted(tokens).alias("tokens")).distinct().withColumn("set", F.monotonically_increasing_id()), "sets"
    )
    named = materialise(vectors.select(F.struct("column", "value").alias("t"), "vector"), "vectors")
    each = sets.select("set", F.explode("tokens").alias("a"), "tokens")
    own = each.select("set", F.col("a").alias("t"), F.lit(1.0).alias("weight"))
    beside = each.select("set", "a", F.explode("tokens").alias("b")).where("a <> b").join(pairs, ["a", "b"])
    parts = own.unionByName(beside.select("set", F.col("b").alias("t"), "weight"))
    # A token's vector is fetched once per set, with the sum of its weights.
    weighed = parts.groupBy("set", "t").agg(F.sum("weight").alias("weight")).join(named, "t")
    sums = weighed.groupBy("set").agg(*(F.sum(F.col("weight") * F.col("vector")[i].cast("double")).alias(f"s{i}") for i in range(size)))

    def mean(i: int) -> Column:
        return F.coalesce(F.col(f"s{i}") / F.size("tokens"), F.lit(0.0))

    return sets.join(sums, "set", "left").select("tokens", F.array(*(mean(i) for i in range(size))).alias("vector"))


def contextual_transform(encoder: RowEncoder, df: DataFrame, pairs: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``<prefix>0..size-1``: contextual row vectors by the encoder's tokens and vectors."""
    named = encoder.tokens(df, "_tokens")
    found = materialise(context_vectors(named, "_tokens", pairs, encoder.vectors, encoder.size), "contexts")
    joined = named.join(found.withColumnRenamed("tokens", "_tokens"), "_tokens")
    names = [f"{encoder.prefix}{i}" for i in range(encoder.size)]
    kept = [quoted(c) for c in (columns or df.columns) if c not in names]
    return joined.select(*kept, *(F.col("vector")[i].alias(n) for i, n in enumerate(names)))
