"""Round trips through files in the shared folder. Each query writes a new path and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskflow.config import SEED
from riskflow.functions.hashing import hash_fraction
from riskflow.operators import categorical, joins
from riskflow.operators.sampling import split_rows
from riskflow.operators.scaling import Scaling, fit_scaling
from riskflow.plans.features import fit_features, write_processed
from riskflow.plans.prepare import Preparation
from riskflow.registry import fraction_sql, query, rounded, table
from riskflow.registry.eda import DOCS, labelled_documents
from riskflow.registry.engineering import mapping_columns, mapping_sql, vocabulary_sql
from riskflow.session import scratch_path
from riskflow.sources import artefacts, buckets, chunks, commit, examples, files, tables
from riskflow.sources.csv_split import read_csv_split

ORDER_SCHEMA = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)


@query("csv_roundtrip", "SELECT * FROM orders")
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "csv")
    table(spark, folder, "orders").write.option("header", True).csv(f"{path}/raw")
    read = tables.read_csv(spark, f"{path}/raw", ORDER_SCHEMA)
    tables.write_parquet(read, f"{path}/interim", rows_per_file=50_000)
    return tables.read_parquet_or_empty(spark, f"{path}/interim", ORDER_SCHEMA)


@query("csv_text_roundtrip", "SELECT * FROM documents")
def csv_text_roundtrip(spark, folder):
    """Whole texts through CSV and partitioned Parquet: quotes, line breaks, commas, backslashes, spaces at the ends."""
    path = scratch_path(spark, "csv-text")
    documents = table(spark, folder, "documents")
    tables.write_csv(documents, f"{path}/raw")
    types = {"doc_id": "bigint", "n_chars": "bigint"}
    tables.write_partitioned(spark, f"{path}/raw", f"{path}/interim", ["lang"], types=types, multiline=True)
    return spark.read.schema(documents.schema).parquet(f"{path}/interim").select(*documents.columns)


@query("csv_report_roundtrip", "SELECT lang, count(*) AS documents, sum(n_chars)::bigint AS characters FROM documents GROUP BY lang")
def csv_report_roundtrip(spark, folder):
    path = scratch_path(spark, "report")
    report = table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))
    tables.write_csv_report(report, path)
    return tables.read_csv(spark, path, types={"documents": "bigint", "characters": "bigint"})


@query("parquet_write_modes", "SELECT * FROM customer")
def parquet_write_modes(spark, folder):
    path = f"{scratch_path(spark, 'modes')}/customer"
    customer = table(spark, folder, "customer")
    tables.write_parquet(customer.withColumn("c_name", F.lit("stale")), path, compression="none")
    tables.write_parquet(customer, path, compression="gzip", overwrite=True)
    return tables.read_parquet(spark, path)


@query("partitioned_write", "SELECT * FROM orders")
def partitioned_write(spark, folder):
    path = scratch_path(spark, "partitioned")
    orders = table(spark, folder, "orders")
    tables.write_parquet(orders, path, partition_by=["o_orderstatus"])
    return spark.read.schema(orders.schema).parquet(path).select(*orders.columns)


@query(
    "file_listing",
    "SELECT o_orderstatus, 1 AS has_files FROM orders GROUP BY o_orderstatus",
)
def file_listing(spark, folder):
    path = scratch_path(spark, "listing")
    tables.write_parquet(table(spark, folder, "orders"), path, partition_by=["o_orderstatus"])
    found = files.list_files(spark, path, ["PARQUET", ".csv"], recursive=True)
    status = F.regexp_extract("path", "o_orderstatus=([^/]+)/", 1)
    return found.groupBy(status.alias("o_orderstatus")).agg(F.lit(1).alias("has_files"))


@query("mapping_json_roundtrip", mapping_columns(mapping_sql("p_brand", "part") + " UNION ALL " + mapping_sql("p_type", "part")))
def mapping_json_roundtrip(spark, folder):
    path = scratch_path(spark, "mapping")
    fitted = categorical.fit_category_mapping(table(spark, folder, "part"), ["p_brand", "p_type"])
    artefacts.write_mapping_json(fitted, path)
    return rounded(artefacts.read_mapping_json(spark, path))


@query(
    "scaling_json_roundtrip",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM part"
        for c in ("p_size", "p_retailprice")
    ),
)
def scaling_json_roundtrip(spark, folder):
    path = scratch_path(spark, "scaling")
    fitted = fit_scaling(table(spark, folder, "part"), ["p_size", "p_retailprice"])
    artefacts.write_scaling(fitted.table(spark), path)
    return rounded(Scaling.from_table(artefacts.read_scaling(spark, path)).table(spark))


EXAMPLE_FEATURES = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "density"]
EXAMPLES_SQL = (
    "SELECT doc_id, text, coalesce(nullif(lang, 'en'), '') AS lang, source, n_chars, coalesce(quality, 0)::bigint AS quality, "
    f"coalesce(toxic, 0)::bigint AS toxic, round(coalesce(quality * 1.0::double / n_chars, 0), 6) AS density FROM {DOCS}"
)


def example_rows(spark, folder):
    return labelled_documents(spark, folder).select(
        "doc_id",
        "text",
        F.nullif("lang", F.lit("en")).alias("lang"),
        "source",
        "n_chars",
        "quality",
        "toxic",
        (F.col("quality") / F.col("n_chars")).alias("density"),
    )


@query("typed_examples", EXAMPLES_SQL)
def typed_examples(spark, folder):
    path = scratch_path(spark, "examples")
    examples.write_examples(example_rows(spark, folder), EXAMPLE_FEATURES, path)
    return rounded(examples.read_examples(spark, path))


@query(
    "chunk_aligned_export",
    "SELECT doc_id, text, lang, source, n_chars, coalesce(quality, 0)::bigint AS quality, coalesce(toxic, -1)::bigint AS toxic "
    f"FROM {DOCS}",
)
def chunk_aligned_export(spark, folder):
    """Join whole tables, then export: a match is found wherever its two rows were stored."""
    path = scratch_path(spark, "export")
    documents = table(spark, folder, "documents")
    joined = joins.left_join(documents, table(spark, folder, "labels"), "doc_id")
    joined = joined.withColumn("toxic", F.coalesce("toxic", F.lit(-1)))
    examples.write_examples(joined, [*documents.columns, "quality", "toxic"], path)
    return examples.read_examples(spark, path)


TRAIN_SQL = f"{fraction_sql('doc_id')} <= 0.8"


@query(
    "prepare_and_merge",
    "SELECT doc_id, text, lang, source, n_chars::double AS n_chars, "
    f"(CASE WHEN {TRAIN_SQL} THEN coalesce(toxic, -1) ELSE -1 END)::int AS toxic, "
    f"coalesce(quality::varchar, 'nan') AS quality_score, CASE WHEN {TRAIN_SQL} THEN 'train' ELSE 'test' END AS split FROM {DOCS}",
)
def prepare_and_merge(spark, folder):
    """Four raw tables with whole texts, prepared, merged and written for both splits; only the train half has targets."""
    path = scratch_path(spark, "prepare")
    rows = labelled_documents(spark, folder).withColumn("train", hash_fraction("doc_id", SEED) <= 0.8)
    labels = table(spark, folder, "labels").withColumn("train", hash_fraction("doc_id", SEED) <= 0.8)
    for split, chosen in (("train", F.col("train")), ("test", ~F.col("train"))):
        transactions = rows.where(chosen).select("doc_id", "text", "lang", "source", "n_chars", *(["toxic"] if split == "train" else []))
        tables.write_csv(transactions, f"{path}/raw/{split}_transaction.csv")
        identity = labels.where(chosen).select("doc_id", F.col("quality").alias("quality-score"))
        tables.write_csv(identity, f"{path}/raw/{split}_identity.csv")
    plan = Preparation(
        f"{path}/raw",
        f"{path}/interim",
        key="doc_id",
        target="toxic",
        categorical=["lang", "source", "quality_score"],
        types={"doc_id": "bigint", "n_chars": "double", "toxic": "int"},
        multiline=True,
    )
    plan.prepare_all(spark)
    plan.write_merged(spark, f"{path}/merged")
    halves = [
        spark.read.parquet(f"{path}/merged/{split}").select(
            "doc_id", "text", "lang", "source", "n_chars", "toxic", "quality_score", F.lit(split).alias("split")
        )
        for split in ("train", "test")
    ]
    return halves[0].unionByName(halves[1])


@query(
    "splits_in_one_dataset",
    f"SELECT *, CASE WHEN {fraction_sql('o_orderkey')} <= 0.8 THEN 'train' ELSE 'test' END AS split FROM orders",
)
def splits_in_one_dataset(spark, folder):
    from riskflow.plans.embedding import write_splits

    rows = split_rows(table(spark, folder, "orders"), "o_orderkey")
    path = scratch_path(spark, "splits")
    write_splits({"train": rows.where("set = 'train'").drop("set"), "test": rows.where("set <> 'train'").drop("set")}, path)
    return spark.read.schema(f"{ORDER_SCHEMA}, split string").parquet(path)


@query("csv_split_roundtrip", "SELECT * FROM documents")
def csv_split_roundtrip(spark, folder):
    """Whole texts in CSV files, written by the tasks that read them and read back by as many as the files have ranges."""
    path = scratch_path(spark, "csv-split")
    documents = table(spark, folder, "documents")
    tables.write_csv(documents, path)
    return read_csv_split(spark, path, documents.schema)


@query(
    "chunked_parquet",
    "SELECT chunk, count(*) AS rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM "
    "(SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 1000 AS chunk FROM orders) GROUP BY chunk",
)
def chunked_parquet(spark, folder):
    """Orders by price, then key, in files of exactly 1000 rows."""
    path = scratch_path(spark, "chunks")
    chunks.write_chunks(table(spark, folder, "orders"), path, 1000, ["o_totalprice", "o_orderkey"])
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^chunk_(\d{6})\.parquet$", 1).cast("bigint")
    return spark.read.parquet(path).groupBy(number.alias("chunk")).agg(
        F.count("*").alias("rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query("resumed_prepare", "SELECT doc_id, quality FROM labels")
def resumed_prepare(spark, folder):
    """Preparation after a run that broke while it wrote: what that left counts for nothing."""
    path = scratch_path(spark, "resumed")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    tables.write_csv(labels, f"{path}/raw/train_identity.csv")
    broken = f"{path}/interim/train/identity"
    labels.limit(3).write.parquet(f"{broken}/_temporary/0/_temporary/attempt_0")
    labels.limit(3).write.parquet(f"{path}/interim/train/_staged-identity-0")
    plan = Preparation(f"{path}/raw", f"{path}/interim", key="doc_id", categorical=[], types={"doc_id": "bigint", "quality": "int"})
    first, again = plan.prepare_all(spark), plan.prepare_all(spark)
    assert (first, again) == (["train/identity"], [])
    assert commit.read_manifest(spark, broken)["rows"] == labels.count()
    return tables.read_parquet(spark, broken)


@query("bucketed_merge", "SELECT l.*, o.o_custkey, o.o_orderstatus, o.o_totalprice FROM lineitem l LEFT JOIN orders o ON o_orderkey = l_orderkey")
def bucketed_merge(spark, folder):
    """Lines with their orders, both bucketed by the key: the merge itself moves no row."""
    path, name = scratch_path(spark, "buckets"), f"merge_{uuid.uuid4().hex}"
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus", "o_totalprice")
    n = buckets.bucket_count(lines, orders, rows=100_000)
    buckets.write_bucketed(lines, f"{name}_lines", f"{path}/lines", "l_orderkey", n)
    buckets.write_bucketed(orders, f"{name}_orders", f"{path}/orders", "l_orderkey", n)
    return buckets.merge_bucketed(spark, f"{name}_lines", f"{name}_orders", "l_orderkey")


@query(
    "vocabulary_roundtrip",
    f"WITH v_p_brand AS ({vocabulary_sql('p_brand', 'part')}), v_p_type AS ({vocabulary_sql('p_type', 'part')}), "
    "sizes AS (SELECT count(DISTINCT p_brand) + 1 AS brands, count(DISTINCT p_type) + 1 AS types FROM part) "
    "SELECT p_partkey, b.index AS p_brand_index, t.index AS p_type_index, brands::int AS brands, types::int AS types, 'p_type,p_size,p_brand' AS feature_order "
    "FROM part JOIN v_p_brand b ON b.token = p_brand JOIN v_p_type t ON t.token = p_type, sizes",
)
def vocabulary_roundtrip(spark, folder):
    """Vocabularies, cardinalities and feature order as stored, applied after reading."""
    path = scratch_path(spark, "vocabulary")
    part = table(spark, folder, "part")
    fitted = categorical.fit_vocabulary(part, ["p_brand", "p_type"])
    artefacts.write_vocabulary(fitted, ["p_type", "p_size", "p_brand"], path)
    stored, order, sizes = artefacts.read_vocabulary(spark, path)
    encoded = categorical.encode_vocabulary(part, stored, ["p_brand", "p_type"])
    return encoded.select(
        "p_partkey", "p_brand_index", "p_type_index", F.lit(sizes["p_brand"]).alias("brands"), F.lit(sizes["p_type"]).alias("types"),
        F.lit(",".join(order)).alias("feature_order"),
    )


PROCESSED = "WITH s AS (SELECT *, CASE WHEN {} <= 0.8 THEN 'train' ELSE 'validation' END AS split FROM orders), ".format(fraction_sql("o_orderkey"))


@query(
    "processed_splits",
    PROCESSED + "m AS (" + mapping_sql("o_orderpriority", "(SELECT * FROM s WHERE split = 'train')") + "), "
    "t AS (SELECT avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std FROM s WHERE split = 'train') "
    "SELECT o_orderkey, round((o_totalprice - mean) / std, 6) + 0.0::double AS o_totalprice, coalesce(m.category, 'Other') AS o_orderpriority, split "
    "FROM s CROSS JOIN t LEFT JOIN m ON m.value = o_orderpriority",
)
def processed_splits(spark, folder):
    """Steps learned from the train half, both halves processed, written and read again."""
    path = scratch_path(spark, "processed")
    rows = split_rows(table(spark, folder, "orders"), "o_orderkey", name="split")
    parts = {n: rows.where(F.col("split") == n) for n in ("train", "validation")}
    steps = fit_features(parts["train"], ["o_orderkey", "o_totalprice", "o_orderpriority", "split"], None, ["o_orderpriority"], scale=["o_totalprice"])
    write_processed(steps, parts, path)
    halves = [tables.read_parquet(spark, f"{path}/{n}") for n in parts]
    return rounded(halves[0].unionByName(halves[1]))
