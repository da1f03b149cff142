"""Mix sources to target weights by Poisson replication.

A document of a source whose texts should appear ``rate`` times on average gets a Poisson number of copies with
that mean: a hash of its key and text, as a fraction of one, is looked up in the distribution's cumulative sums. The
number depends on these, the seed and the rate alone, so a task that runs again gives the same copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.hashing import hash_fraction, hash_text
from riskflow.llm.common import fresh
from riskflow.session import materialise

SEED = 17
TEMPERATURE = 0.5


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE,
    source: str = "source", text: str = "text", epochs: float = 1.0,
) -> DataFrame:
    """Table (source, characters, rate): how often each source's documents should appear on average.

    With ``weights`` the sources get those shares of ``epochs`` times all characters (a source that isn't named gets
    none, shares need not sum to one). Without, a source's share is in proportion to its characters to the power
    ``temperature``. A null source is a source of its own; one without characters has rate 1, unless it gets none.
    """
    mass = materialise(
        docs.groupBy(F.col(f"`{source}`").alias("source"))
        .agg(F.sum(F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0))).cast("bigint").alias("characters")),
        "sources",
    )
    if weights is None:
        share, bare = F.pow(F.col("characters").cast("double"), F.lit(float(temperature))), F.lit(1.0)
    elif weights:
        found = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("source")]
        share, bare = F.coalesce(found.cast("double"), F.lit(0.0)), F.when(found > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    else:
        share = bare = F.lit(0.0)
    shares = mass.withColumn("share", F.when(F.col("characters") > 0, share).otherwise(F.lit(0.0)))
    total = shares.agg(F.sum("characters").alias("c"), F.sum("share").alias("s")).first()
    goal = float(epochs) * float(total.c or 0)
    rate = F.col("share") / F.lit(total.s or 1.0) * F.lit(goal) / F.col("characters")
    return shares.select("source", "characters", F.when(F.col("characters") > 0, rate).otherwise(bare).alias("rate"))


def cumulative(rates: DataFrame) -> DataFrame:
    """(source, rate, sums) of the sources with a rate: ``sums`` is an ascending array of P(copies <= k) for k = 0, 1, ... until what is
    left is below the hash's resolution. Its length, and what a source's window holds, is in proportion to the rate."""
    last = F.ceil(F.col("rate") + F.sqrt("rate") * 12 + 40).cast("int")
    steps = rates.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    window = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log = F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.ln(F.col("rate") / F.col("k")))).over(window)
    total = F.sum(F.exp("log")).over(window)
    return (
        steps.withColumn("log", log).withColumn("total", total)
        .groupBy("source").agg(F.first("rate").alias("rate"), F.sort_array(F.collect_list("total")).alias("sums"))
    )


def poisson_mix(
    docs: DataFrame, rates: DataFrame, seed: int = SEED, key: str = "doc_id", source: str = "source",
    copy: str | None = None, text: str = "text",
) -> DataFrame:
    """Each row of ``docs`` as often as its draw says, in an order that mixes all sources; columns as they were.

    ``copy`` names a column for the number of the copy, from 1. Rows that are equal in key, text and source get equal counts; rows
    without a key are told apart by their texts (a null text is the empty one). Rows whose source has no rate are left out, as at
    rate 0; an empty table gives no rows. Nothing is grouped by source: the rates are one row per source and a hot source's rows stay
    where they are until the shuffle by hash.
    """
    name, table, number, order, seen = fresh(docs, "rate_source", "sums", "copy_number", "order", "text_hash")
    ready = materialise(cumulative(rates).select(F.col("source").alias(name), F.col("sums").alias(table)), "rates")
    marked = docs.withColumn(seen, F.md5(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))))
    draw = hash_fraction([f"`{key}`", seen], seed)
    copies = F.size(F.filter(F.col(table), lambda below: below <= draw))
    drawn = (
        marked.join(ready, F.col(f"`{source}`").eqNullSafe(F.col(name)))
        .withColumn(number, copies)
        .where(F.col(number) > 0)
        .withColumn(number, F.explode(F.sequence(F.lit(1), F.col(number))))
        .withColumn(order, hash_text([f"`{key}`", seen, number], seed))
    )
    mixed = drawn.repartition(F.col(order)).sortWithinPartitions(order)
    extra = [F.col(number).alias(copy)] if copy else []
    return mixed.select(*(F.col(f"`{c}`") for c in docs.columns), *extra)
