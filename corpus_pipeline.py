"""From raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import exact_dedup, mixing, ngram_join, packing, queries, tokens, toxicity
from riskflow.llm.common import fresh
from riskflow.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject.

    Null and empty texts have the score of a text without words, which is clean; long texts are read whole. Repeated rows share their
    score, so they stay or go together; rows without a key are scored but don't train. Other columns pass through, whatever they are
    called. An empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "toxicity")
    return toxicity.score(docs, model, "text", score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space.

    Null and empty texts are one group with those of white space only. The longest original stays; ties go to the smallest key, a
    null key last, and one of rows that are equal throughout stays. Other columns pass through; an empty table stays empty.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a Jaccard similarity of 0.75 or more of five-word shingles.

    The smallest key of a group stays. Texts without words, null ones included, link with nothing and stay, each row of them.
    Long texts are compared whole. Other columns pass through; an empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws, in mixed order.

    A null source is a source of its own; one without characters has rate 1. Rows that are equal in key, text and source draw alike.
    Other columns pass through, whatever they are called; an empty table stays empty.
    """
    return mixing.poisson_mix(docs, mixing.source_rates(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens.

    A null or empty text is its end id alone. Long texts are cut; repeated rows are documents of their own. Other columns aren't read;
    an empty table has no pieces.
    """
    return queries.digested(packing.pack_documents(docs, tokens.tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier's scores and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what its predecessor kept, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
