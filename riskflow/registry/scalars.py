"""Scalar expressions and user functions over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from riskflow.functions import scalars
from riskflow.operators.partition import BatchStep, score_batches
from riskflow.registry import query, rounded, table


@query(
    "string_scalars",
    "SELECT doc_id, doc_id::varchar AS as_text, replace(source || '-' || lang, '-', '_') AS underscored, "
    "(lower(source) LIKE '%rc1%')::int AS matched, try_cast(regexp_extract(source, 'src([0-9]+)', 1) AS int) AS source_number, "
    "CASE WHEN source LIKE 'src1%' THEN try_cast(split_part(source || '_' || n_chars, '_', 2) AS int) END AS suffix, "
    "lower(regexp_extract('dir/' || source || '.CSV', '(\\.[^./]+)$', 1)) AS extension, lpad(doc_id::varchar, 6, '0') AS padded "
    "FROM documents",
)
def string_scalars(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        scalars.to_text("doc_id").alias("as_text"),
        scalars.underscored(F.concat_ws("-", "source", "lang")).alias("underscored"),
        scalars.matches("source", "RC1").cast("int").alias("matched"),
        scalars.extract_integer("source", "src([0-9]+)").alias("source_number"),
        scalars.suffix_number(F.concat_ws("_", "source", "n_chars"), "src1").alias("suffix"),
        scalars.file_suffix(F.concat(F.lit("dir/"), "source", F.lit(".CSV"))).alias("extension"),
        scalars.zero_padded("doc_id").alias("padded"),
    )


@query(
    "math_scalars",
    "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_tax * 10 - 2))), 6) AS sigmoid, "
    "least(greatest(l_discount, 0.02), 0.08)::double AS clipped, round(ln(l_quantity), 6) AS logged, "
    "round(pow(l_tax, 2), 6) AS squared, round(abs(l_tax - l_discount), 6) AS gap, (l_discount * 10 >= 0.5)::int AS above, "
    "l_extendedprice::bigint - (l_extendedprice::bigint > l_extendedprice)::int AS truncated, l_orderkey % 7 AS remainder, "
    "CASE WHEN l_discount > 0 THEN l_discount END AS present, (nullif(l_tax, 0) IS NULL)::int AS missing FROM lineitem",
)
def math_scalars(spark, folder):
    c = F.col
    return rounded(
        table(spark, folder, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            scalars.sigmoid(c("l_tax") * 10 - 2).alias("sigmoid"),
            scalars.clip("l_discount", 0.02, 0.08).alias("clipped"),
            F.ln("l_quantity").alias("logged"),
            F.pow("l_tax", F.lit(2)).alias("squared"),
            F.abs(c("l_tax") - c("l_discount")).alias("gap"),
            scalars.at_least(c("l_discount") * 10, 0.5).alias("above"),
            c("l_extendedprice").cast("bigint").alias("truncated"),
            F.pmod("l_orderkey", F.lit(7)).cast("bigint").alias("remainder"),
            F.when(c("l_discount") > 0, c("l_discount")).alias("present"),
            F.nullif("l_tax", F.lit(0.0)).isNull().cast("int").alias("missing"),
        )
    )


class PriceBand(BatchStep):
    """A user's pandas step: the price in whole thousands."""

    output_schema = "o_orderkey bigint, band bigint"

    def compute_batch(self, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_orderkey": batch["o_orderkey"], "band": (batch["o_totalprice"] // 1000).astype("int64")})


@query("partition_apply", "SELECT o_orderkey, floor(o_totalprice / 1000)::bigint AS band FROM orders")
def partition_apply(spark, folder):
    return PriceBand().compute(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"))


@query("batch_scoring", "SELECT event_id, round(value * 2 + 1, 6) AS score FROM events")
def batch_scoring(spark, folder):
    """A foreign model, here a line, loaded once per task and applied to bounded batches."""

    def load():
        return lambda batch: pd.DataFrame({"event_id": batch["event_id"], "score": batch["value"] * 2 + 1})

    events = table(spark, folder, "events").select("event_id", "value")
    return rounded(score_batches(events, load, "event_id bigint, score double"))
