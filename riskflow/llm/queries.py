"""The dealt operators bound to the shared tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import (
    chat, exact_dedup, fingerprints, mixing, ngram_join, packing, repeats, token_counts, tokens, toxicity, tree_queries,
)
from riskflow.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.train(documents, labels.where(~toxicity.held_out("doc_id")))
    scored = toxicity.score(documents.select("doc_id", "text"), model, "text", "score")
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(_table(spark, folder, "documents"), path, tokens.tokenizer_path())
    read = tokens.read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = repeats.remove_repeats(_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), tokens.tokenizer_path("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return digested(packing.pack_documents(_table(spark, folder, "documents"), tokens.tokenizer_path()))


def digested(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(_table(spark, folder, "documents"))


def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, folder, "documents"))


PROBE = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    conversations = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr(
        "-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{PROBE}' AS text"
    )
    formatted = chat.format_conversations(conversations.unionByName(probe))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                turns = chat.read_turns(row["formatted"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = [chat.unescape(row["formatted"][s["start"] : s["end"]]) for s in row["segments"] if s["loss"]]
                rows.append(
                    {
                        "conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": sha256(said.encode()).hexdigest(),
                        "loss_chars": sum(map(len, loss)), "loss_sha256": sha256("".join(loss).encode()).hexdigest(),
                        "formatted_chars": len(row["formatted"]), "valid": row["valid"],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, _CHAT)

    return formatted.mapInArrow(
        read,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, valid boolean",
    )


_CHAT = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()),
    ]
)


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, folder, "documents"))
    return groups.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS raw, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(raw) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    mixed = mixing.poisson_mix(documents, mixing.source_rates(documents), copy="copy")
    return mixed.select("doc_id", "source", "lang", "copy", F.md5("text").alias("text_md5"))


OP10_SQL = f"""
WITH RECURSIVE mass AS (
  SELECT source, sum(length(coalesce(text, ''))) AS characters FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN characters > 0
    THEN sqrt(characters) / (SELECT sum(sqrt(characters)) FROM mass) * (SELECT sum(characters) FROM mass) / characters
    ELSE 1.0 END AS rate
  FROM mass
), sums(source, rate, k, logp, total) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, logp + ln(rate / (k + 1)), total + exp(logp + ln(rate / (k + 1))) FROM sums
  WHERE k < ceil(rate + sqrt(rate) * 12 + 40)
), draws AS (
  SELECT d.*, ('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 8))::bigint / 4294967296.0 AS u FROM documents d
)
SELECT d.doc_id, d.source, d.lang, (s.k + 1)::integer AS copy, md5(d.text) AS text_md5
FROM draws d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source AND s.total <= d.u
"""

QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_toxicity, op2_token_files, op3_repeats, op4_token_counts, op5_packing, op6_fingerprints, op7_jaccard,
        op8_chat, op9_exact_dedup, op10_mixing,
    )
} | tree_queries.QUERIES
ORACLES: dict[str, str] = {"op9_exact_dedup": OP9_SQL, "op10_mixing": OP10_SQL, **tree_queries.ORACLES}
