"""Whole-or-absent tables, exact chunks, CSV by ranges, bucketed merges."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from riskflow.plans.prepare import Preparation
from riskflow.sources import artefacts, buckets, chunks, commit, files, tables
from riskflow.sources.csv_split import read_csv_split


# -- commit ------------------------------------------------------------------------------------------
def test_a_broken_write_is_no_table(spark, tmp_path):
    target = tmp_path / "interim" / "train" / "identity"
    os.makedirs(target / "_temporary" / "0" / "_temporary" / "attempt_1")
    (target / "_temporary" / "0" / "_temporary" / "attempt_1" / "part-0.parquet").touch()
    os.makedirs(tmp_path / "raw")
    (tmp_path / "raw" / "train_identity.csv").write_text("TransactionID,id_01\n1,2.0\n2,3.0\n")
    assert not files.has_files(spark, str(target), "parquet") and not commit.is_complete(spark, str(target))
    plan = Preparation(str(tmp_path / "raw"), str(tmp_path / "interim"), categorical=[])
    assert plan.prepare_all(spark) == ["train/identity"]
    assert plan.prepare_all(spark) == []
    assert rows(tables.read_parquet(spark, str(target))) == [(1, 2.0), (2, 3.0)]
    manifest = commit.read_manifest(spark, str(target))
    assert manifest["rows"] == 2 and manifest["columns"] == [["TransactionID", "bigint"], ["id_01", "double"]]


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    target = str(tmp_path / "t")
    commit.commit_parquet(spark.range(5), target)

    def broken(folder):
        spark.range(9).write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        commit.commit_table(spark, target, broken)
    assert spark.read.parquet(target).count() == 5 and commit.is_complete(spark, target)
    assert commit.discard_staged(spark, target) == 1 and sorted(os.listdir(tmp_path)) == ["t"]
    with pytest.raises(Exception, match="divi"):
        commit.commit_parquet(spark.range(5).select((F.lit(1) / (F.col("id") - 2)).alias("x")), target)
    assert spark.read.parquet(target).count() == 5


def test_a_table_that_lost_files_or_its_manifest_is_not_complete(spark, tmp_path):
    target = str(tmp_path / "t")
    commit.commit_parquet(spark.range(0, 6, 1, 3), target)
    assert commit.is_complete(spark, target)
    victim = next(n for n in os.listdir(target) if n.endswith(".parquet"))
    os.remove(f"{target}/{victim}")
    assert not commit.is_complete(spark, target)
    commit.commit_parquet(spark.range(4), target)
    assert commit.is_complete(spark, target) and json.load(open(f"{target}/{commit.MANIFEST}"))["rows"] == 4
    os.remove(f"{target}/{commit.MANIFEST}")
    assert not commit.is_complete(spark, target) and not commit.is_complete(spark, str(tmp_path / "none"))


# -- chunks ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("order", [[], ["v", "id"]])
def test_chunks_are_exact_and_in_order(spark, tmp_path, order):
    df = spark.range(0, 1003, 1, 7).select("id", (F.col("id") * 37 % 11).alias("v"))
    out = str(tmp_path / "c")
    assert chunks.write_chunks(df, out, 100, order) == 11
    assert sorted(n for n in os.listdir(out) if n.endswith(".parquet")) == [f"chunk_{i:06d}.parquet" for i in range(11)]
    expected = sorted(((r["id"], r["v"]) for r in df.collect()), key=lambda r: (r[1], r[0]) if order else r)
    for i in range(11):
        found = [tuple(r) for r in spark.read.parquet(f"{out}/chunk_{i:06d}.parquet").collect()]
        assert found == expected[100 * i : 100 * i + 100]


def test_chunks_of_no_rows_and_of_one_row_each(spark, tmp_path):
    assert chunks.write_chunks(spark.range(0), str(tmp_path / "none"), 5) == 0
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
    assert chunks.write_chunks(spark.range(3), str(tmp_path / "one"), 1) == 3
    with pytest.raises(ValueError):
        chunks.write_chunks(spark.range(3), str(tmp_path / "bad"), 0)


def test_prepared_chunks_follow_the_raw_file(spark, tmp_path):
    os.makedirs(tmp_path / "raw")
    (tmp_path / "raw" / "train_identity.csv").write_text("TransactionID,id_01\n" + "".join(f"{i},{i / 2}\n" for i in range(10)))
    Preparation(str(tmp_path / "raw"), str(tmp_path / "interim"), categorical=[], rows_per_file=3).prepare_all(spark)
    folder = tmp_path / "interim" / "train" / "identity"
    for i, ids in enumerate([[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]):
        assert [r["TransactionID"] for r in spark.read.parquet(str(folder / f"chunk_{i:06d}.parquet")).collect()] == ids


# -- CSV by ranges -----------------------------------------------------------------------------------
@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


TEXTS = [
    "plain", "two\nlines", 'said "so"\n"and" left', "", None, '"', '""\n""', "a,b\n,c", "long " * 60 + "\nend", "\n", "\n\n\n", "tail\n",
    "crlf\r\ninside", "ä\nö ü 中", "back\\slash\n\\", 'x"', '\n"', " spaces \n ", "007", "last",
]


@pytest.mark.parametrize("parts", [1, 3])
def test_csv_ranges_give_the_rows_of_the_file(spark, tmp_path, small_ranges, parts):
    made = [(i, TEXTS[(i * 7) % len(TEXTS)], i / 4) for i in range(80)]
    df = spark.createDataFrame(made, "id bigint, text string, x double")
    tables.write_csv(df.repartition(parts, "id"), str(tmp_path / "csv"))
    found = read_csv_split(spark, str(tmp_path / "csv"), df.schema)
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(df.schema).csv(str(tmp_path / "csv"))
    assert rows(found) == rows(whole)
    assert {r["text"] for r in found.collect()} >= {t for t in TEXTS if t}
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "csv"))
    assert lines.rdd.getNumPartitions() > 10 * parts


def test_csv_round_trip_writes_by_many_tasks(spark, tmp_path):
    from riskflow.registry.storage import csv_split_roundtrip

    made = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)] or "x", "en") for i in range(80)], "doc_id bigint, text string, lang string")
    made.repartition(4, "doc_id").write.option("maxRecordsPerFile", 20).parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = csv_split_roundtrip(spark, str(tmp_path))
        assert rows(found) == rows(made)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len([f for f in found.inputFiles() if f.endswith(".csv")]) >= 4


def test_csv_ranges_with_carriage_returns_and_empty_lines(spark, tmp_path, small_ranges):
    body = "id,text\r\n" + "".join(f'{i},"v {i}\r\nmore ""q"" {i}"\r\n' + ("\r\n" if i % 5 == 0 else "") for i in range(40))
    (tmp_path / "in.csv").write_bytes(body.encode())
    found = read_csv_split(spark, str(tmp_path / "in.csv"), "id bigint, text string")
    assert rows(found) == [(i, f'v {i}\r\nmore "q" {i}') for i in range(40)]


def test_csv_of_a_header_alone(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,text\n")
    assert read_csv_split(spark, str(tmp_path / "in.csv"), "id bigint, text string").count() == 0
    assert tables.read_csv(spark, str(tmp_path / "in.csv"), multiline=True, types={"id": "bigint"}).dtypes == [("id", "bigint"), ("text", "string")]


def test_ranges_are_cut_alike_past_the_broadcast_bound(spark, tmp_path, small_ranges, monkeypatch):
    import riskflow.sources.csv_split as module

    monkeypatch.setattr(module, "small_enough", lambda table: False)
    df = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)] or "") for i in range(60)], "id bigint, text string")
    tables.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    found = read_csv_split(spark, str(tmp_path / "csv"), df.schema)
    assert {(r["id"], r["text"] or "") for r in found.collect()} == {tuple(r) for r in df.collect()}


# -- buckets -----------------------------------------------------------------------------------------
def test_bucketed_merge_shuffles_nothing(spark, tmp_path):
    left = spark.range(200).select((F.col("id") % 90).alias("k"), "id").withColumn("k", F.when(F.col("id") > 0, F.col("k")))
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    n = buckets.bucket_count(left, right, rows=50)
    assert n == 4 and buckets.bucket_count(right) == 1
    buckets.write_bucketed(left, "bucket_left", str(tmp_path / "l"), "k", n)
    buckets.write_bucketed(right, "bucket_right", str(tmp_path / "r"), "k", n)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = buckets.merge_bucketed(spark, "bucket_left", "bucket_right", "k")
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        expected = left.join(right, "k", "left").select("k", "id", "v")
        assert rows(merged) == rows(expected) and merged.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len([f for f in os.listdir(tmp_path / "l") if f.endswith(".parquet")]) <= n
    buckets.write_bucketed(right, "bucket_left", str(tmp_path / "l"), "k", n)  # replaces
    assert spark.table("bucket_left").count() == 60
    with pytest.raises(ValueError):
        buckets.write_bucketed(right, "bucket_left", str(tmp_path / "l"), "gone", n)
    spark.sql("DROP TABLE bucket_left")
    spark.sql("DROP TABLE bucket_right")


def test_vocabulary_is_read_as_written(spark, tmp_path):
    made = [("a", "x=1/2", 1, 5), ("a", "y", 2, 3), ("b c", "", 1, 2)]
    vocabulary = spark.createDataFrame(made, "column string, token string, index int, count bigint")
    artefacts.write_vocabulary(vocabulary, ["n", "a", "b c"], str(tmp_path / "v"))
    stored, order, sizes = artefacts.read_vocabulary(spark, str(tmp_path / "v"))
    assert rows(stored) == sorted(made) and order == ["n", "a", "b c"] and sizes == {"a": 3, "b c": 2}
