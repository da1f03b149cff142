"""Row embeddings from column-value tokens (FE-11..14, AGG-19, MDL-12).

A row has one token per column: the column and its value, or the bin of a number between exact quantiles. How often
two tokens stand in one row is counted and factored by Spark's alternating least squares; a row's vector is the
mean of its tokens' vectors. Counts and vectors are tables, so neither the number of values nor that of rows has a
bound on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.scalars import number, quoted, value_text
from riskflow.operators.categorical import apply_category_mapping, fit_category_mapping
from riskflow.operators.joins import lookup
from riskflow.operators.ordering import row_positions
from riskflow.operators.profile import exact_quantiles
from riskflow.session import materialise
from riskflow.sources.artefacts import read_settings, write_settings

BLOCKS = 10


@dataclass
class RowEncoder:
    """Fitted token vectors: ``vectors`` has one row (column, value, count, vector) per token."""

    categorical: list[str]
    numeric: list[str]
    splits: dict[str, list[float]]
    grouping: DataFrame | None
    vectors: DataFrame
    size: int
    prefix: str = "encoder_emb_"

    def tokens(self, df: DataFrame, name: str = "_tokens") -> DataFrame:
        """``df`` with an array of (column, value), one per column of the encoder."""
        texts = self._texts()
        valued = self._valued(df)
        return valued.withColumn(
            name, F.array(*(F.struct(F.lit(c).alias("column"), F.col(t).alias("value")) for c, t in texts.items()))
        ).drop(*texts.values())

    def _texts(self) -> dict[str, str]:
        return {c: f"_token_{i}" for i, c in enumerate([*self.categorical, *self.numeric])}

    def _valued(self, df: DataFrame) -> DataFrame:
        """``df`` with the text of every token in a column of its own."""
        texts = self._texts()
        found = df.withColumns(
            {texts[c]: value_text(df.schema[c]) for c in self.categorical}
            | {texts[c]: F.coalesce(_bin(number(df.schema[c]), self.splits[c]).cast("string"), F.lit("nan")) for c in self.numeric}
        )
        if self.grouping is None:
            return found
        # The mapping goes by column name, here that of the copy.
        named = F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))
        return apply_category_mapping(found, self.grouping.withColumn("column", named[F.col("column")]), [texts[c] for c in self.categorical])

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<prefix>0..size-1``: the mean vector of each row's tokens; unknown tokens count as zero."""
        texts = self._texts()
        zero = F.array(*(F.lit(0.0).cast("float") for _ in range(self.size)))
        found = self._valued(df)
        for i, (c, t) in enumerate(texts.items()):
            found = lookup(found, t, self.vectors.where(F.col("column") == c), "value", "vector", f"_vector_{i}", zero, "count")
        names = [f"{self.prefix}{i}" for i in range(self.size)]
        kept = [quoted(c) for c in df.columns if c not in names]

        def mean(i: int) -> Column:
            return sum((F.col(f"_vector_{j}")[i].cast("double") for j in range(len(texts))), F.lit(0.0)) / F.lit(len(texts))

        return found.select(*kept, *(mean(i).alias(n) for i, n in enumerate(names)))

    def value_vectors(self) -> DataFrame:
        """(column, value, vector): the dense vector of each category value or bin."""
        return self.vectors.select("column", "value", "vector")

    def save(self, path: str) -> None:
        """Vectors and grouping as Parquet, the rest as JSON, under one folder."""
        settings = {"categorical": self.categorical, "numeric": self.numeric, "splits": self.splits, "size": self.size}
        write_settings(self.vectors.sparkSession, {**settings, "prefix": self.prefix, "grouped": self.grouping is not None}, f"{path}/settings")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        if self.grouping is not None:
            self.grouping.write.mode("overwrite").parquet(f"{path}/grouping")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RowEncoder:
        s = read_settings(spark, f"{path}/settings")
        grouping = spark.read.parquet(f"{path}/grouping") if s.pop("grouped") else None
        return cls(**s, grouping=grouping, vectors=spark.read.parquet(f"{path}/vectors"))


def _bin(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value; null for null."""
    return sum(((x >= F.lit(s)).cast("int") for s in edges), F.when(x.isNotNull(), F.lit(0)))


def fit_row_encoder(
    df: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str] = (),
    size: int = 8,
    bins: int = 8,
    seed: int = 42,
    rounds: int = 5,
    blocks: int = BLOCKS,
    group_share: float | None = None,
) -> RowEncoder:
    """Learn token vectors from the rows of ``df``.

    ``group_share`` puts the categorical columns through category grouping first, so that values beyond that share of
    the rows are one token; without it every value has its vector. The result depends on the rows, the seed and
    ``blocks``, not on cores or partitions.
    """
    splits: dict[str, list[float]] = {}
    if numeric:
        inner = [i / bins for i in range(1, bins)]
        edges = {r["column"]: r for r in exact_quantiles(df, numeric, inner).collect()}  # one row per column
        splits = {c: sorted({edges[c][f"q{i}"] for i in range(len(inner))}) if c in edges else [] for c in numeric}
    grouping = fit_category_mapping(df, categorical, group_share) if categorical and group_share is not None else None
    encoder = RowEncoder(list(categorical), list(numeric), splits, grouping, df.limit(0), size)
    # Rows with the same tokens are one, with their number.
    sets = materialise(encoder.tokens(df).groupBy("_tokens").agg(F.count("*").alias("_rows")), "tokens")

    counts = materialise(
        sets.select(F.explode("_tokens").alias("t"), "_rows").groupBy("t.column", "t.value").agg(F.sum("_rows").alias("count")), "counts"
    )
    placed = materialise(row_positions(counts, [], [F.desc("count"), F.col("column"), F.col("value")], "id"), "vocabulary")
    pairs = (
        sets.select(F.explode("_tokens").alias("a"), "_tokens", "_rows").select("a", "_rows", F.explode("_tokens").alias("b"))
        .where("a <> b").groupBy("a", "b").agg(F.sum("_rows").alias("times"))
    )
    ids = placed.select(F.struct("column", "value").alias("token"), F.col("id").cast("int").alias("id"))
    together = (
        pairs.join(ids.select(F.col("token").alias("a"), F.col("id").alias("i")), "a")
        .join(ids.select(F.col("token").alias("b"), F.col("id").alias("j")), "b")
        .select("i", "j", F.ln(F.col("times") + 1.0).cast("float").alias("weight"))
    )
    zero = F.array(*(F.lit(0.0).cast("float") for _ in range(size)))
    if together.isEmpty():  # rows of one column only
        learned = placed.select("id", zero.alias("vector"))
    else:
        ordered = materialise(together.repartition(blocks, F.xxhash64("i", "j")).sortWithinPartitions("i", "j"), "pairs")
        als = ALS(rank=size, maxIter=rounds, implicitPrefs=True, seed=seed, userCol="i", itemCol="j", ratingCol="weight", numUserBlocks=blocks, numItemBlocks=blocks)
        learned = als.fit(ordered).userFactors.select("id", F.col("features").alias("vector"))
    vectors = placed.join(learned, "id", "left").select("column", "value", "count", F.coalesce("vector", zero).alias("vector"))
    encoder.vectors = materialise(vectors, "vectors")
    return encoder
