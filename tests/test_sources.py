"""Files, CSV, Parquet, artefacts, examples and the preparation flow."""

import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from riskflow.config import CATEGORICAL_FEATURES, USED_FEATURES
from riskflow.operators.categorical import fit_category_mapping
from riskflow.plans.prepare import Preparation
from riskflow.sources import artefacts, examples, files, tables

TREE = ["ledger.csv", "_draft.CSV", ".hidden.csv", "rates.parquet", "README", "day=1/ledger.csv", "day=1/rates.parquet", "plain/deep/rates.parquet"]


@pytest.fixture
def tree(tmp_path):
    for name in TREE:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).touch()
    return str(tmp_path)


def listed(spark, *args, **options):
    return [os.path.basename(r["path"]) for r in files.list_files(spark, *args, **options).collect()]


@pytest.mark.parametrize("extension", [None, "csv", ".csv", "*.csv", "CSV", ["csv", ".parquet"], ".xyz"])
@pytest.mark.parametrize("recursive", [False, True])
def test_list_files(spark, tree, extension, recursive):
    """Hidden names, upper case, partition folders beside plain ones: as walking the tree finds them."""
    wanted = ["csv"] if isinstance(extension, str) and "csv" in extension.lower() else extension
    endings = {None: ("",), ".xyz": (".xyz",)}.get(extension) if not isinstance(wanted, list) else tuple("." + e.lstrip(".") for e in wanted)
    expected = sorted(n for n in TREE if (recursive or "/" not in n) and n.lower().endswith(endings))
    found = [r["path"] for r in files.list_files(spark, tree, extension, recursive).collect()]
    assert found == sorted(found) and sorted(p.split(f"{tree}/")[1] for p in found) == expected


def test_files_of_subfolders_are_found(spark, tree):
    assert files.has_files(spark, tree, "parquet") and files.has_files(spark, f"{tree}/plain", "parquet")
    assert not files.has_files(spark, f"{tree}/day=1", "xyz") and not files.has_files(spark, f"{tree}/none", "csv")
    assert files.file_count(spark, tree) == 3


def test_list_files_ignores_case_of_the_file(spark, tmp_path):
    (tmp_path / "A.CSV").touch()
    (tmp_path / "b.Csv").touch()
    assert listed(spark, str(tmp_path), ".csv") == ["A.CSV", "b.Csv"]


def test_list_files_errors(spark, tree):
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, f"{tree}/missing")
    with pytest.raises(NotADirectoryError):
        files.list_files(spark, f"{tree}/ledger.csv")


def test_no_parquet_is_an_error(spark, tree, tmp_path_factory):
    empty = str(tmp_path_factory.mktemp("empty"))
    with pytest.raises(FileNotFoundError, match="No Parquet files found"):
        tables.read_parquet(spark, empty)
    with pytest.raises(FileNotFoundError):
        tables.read_parquet(spark, f"{empty}/missing")
    assert tables.read_parquet_or_empty(spark, empty, "a int").count() == 0
    assert tables.read_parquet_or_empty(spark, f"{empty}/missing", "a int").count() == 0


# -- preparation -----------------------------------------------------------------------------------
def raw_tables(folder, names=("train_identity", "train_transaction", "test_identity", "test_transaction")):
    """Each transaction has a code with leading zeros and a note with quotes, commas and a line break; two in three have an identity."""
    os.makedirs(folder, exist_ok=True)
    for name in names:
        with open(f"{folder}/{name}.csv", "w", encoding="utf-8") as f:
            if "identity" in name:
                f.write("TransactionID,id-01,id_02\n" + "".join(f"{700 + i},{i / 4},device {i % 2}\n" for i in range(10) if i % 3))
            else:
                lines = (f'{700 + i},{12.5 * i},00{i},"said ""{i}"", then\nleft"\n' for i in range(10))
                f.write("TransactionID,TransactionAmt,ProductCD,note\n" + "".join(lines))


def plan(tmp_path, **options):
    return Preparation(str(tmp_path / "raw"), str(tmp_path / "interim"), types={"id_02": "string"}, multiline=True, **options)


def parquet_files(folder):
    return sorted(n for n in os.listdir(folder) if n.endswith(".parquet"))


def test_prepare_all(spark, tmp_path):
    raw_tables(tmp_path / "raw")
    p = plan(tmp_path, rows_per_file=3)
    assert p.prepare_all(spark) == ["train/identity", "train/transactions", "test/identity", "test/transactions"]
    for folder, n in (("train/identity", 2), ("test/transactions", 4)):
        assert len(parquet_files(tmp_path / "interim" / folder)) == n
    identity, transactions = tables.load_split(spark, p.interim, "test")
    assert identity.columns == ["TransactionID", "id_01", "id_02"]
    assert dict(identity.dtypes)["id_01"] == "double"
    assert {r["isFraud"] for r in transactions.collect()} == {-1}
    assert {r["note"] for r in transactions.collect()} == {f'said "{i}", then\nleft' for i in range(10)}
    assert {r["ProductCD"] for r in transactions.collect()} == {f"00{i}" for i in range(10)}
    assert "isFraud" not in tables.load_split(spark, p.interim, "train")[1].columns
    merged = p.merged(spark, "train")
    assert merged.count() == 10 and "id_02" in merged.columns
    p.write_merged(spark, str(tmp_path / "merged"))
    assert spark.read.parquet(str(tmp_path / "merged" / "test")).count() == 10


def test_missing_raw_files_are_skipped(spark, tmp_path):
    raw_tables(tmp_path / "raw", ["train_identity"])
    assert plan(tmp_path).prepare_all(spark) == ["train/identity"]
    assert plan(tmp_path).prepare_all(spark) == []


def test_overwrite(spark, tmp_path):
    raw_tables(tmp_path / "raw", ["train_identity"])
    p, folder = plan(tmp_path, rows_per_file=2), tmp_path / "interim" / "train" / "identity"
    p.prepare_all(spark)
    before = {n: os.path.getmtime(folder / n) for n in parquet_files(folder)}
    time.sleep(0.02)
    p.prepare_all(spark)
    assert {n: os.path.getmtime(folder / n) for n in parquet_files(folder)} == before
    p.rows_per_file = None
    p.prepare_all(spark, overwrite=True)
    assert len(parquet_files(folder)) == 1  # nothing stale is left behind
    assert min(os.path.getmtime(folder / n) for n in parquet_files(folder)) > max(before.values())


def test_prepare_fills_an_existing_empty_folder(spark, tmp_path):
    raw_tables(tmp_path / "raw", ["train_identity"])
    os.makedirs(tmp_path / "interim" / "train" / "identity")
    assert plan(tmp_path).prepare_all(spark) == ["train/identity"]


def test_a_missing_key_fails_the_write(spark, tmp_path):
    os.makedirs(tmp_path / "raw")
    (tmp_path / "raw" / "train_identity.csv").write_text("TransactionID,id_01\n1,2.0\n,3.0\n")
    with pytest.raises(Exception, match="null in key column"):
        plan(tmp_path).prepare_all(spark)


def test_load_split(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.load_split(spark, str(tmp_path), "validation")
    identity, transactions = tables.load_split(spark, str(tmp_path), "train")
    assert identity.count() == transactions.count() == 0


def test_chunks_hold_all_rows(spark, tmp_path):
    df = spark.range(230).select((F.col("id") * 3).alias("order"), (F.col("id") % 7).cast("string").alias("lane"), (F.col("id") / 8).alias("weight"))
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    schema = "order bigint, lane string, weight double"
    n = tables.write_partitioned(spark, str(tmp_path / "in"), str(tmp_path / "out"), rows_per_file=50, schema=schema)
    assert n == 5
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(df)


def test_csv_text_survives(spark, tmp_path):
    texts = ["Grüße", "𝕏 and 中", 'a "quoted" word', '"', "first\nsecond\r\nthird", "comma, tab\t", "back\\slash \\", "007"]
    df = spark.createDataFrame([(i, t, "0042") for i, t in enumerate(texts)], "id bigint, text string, code string")
    tables.write_csv_report(df, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), types={"id": "bigint"}, multiline=True)
    assert rows(back) == rows(df)
    n = tables.write_partitioned(spark, str(tmp_path / "csv"), str(tmp_path / "out"), ["code"], types={"id": "bigint"}, multiline=True)
    assert n and rows(spark.read.parquet(str(tmp_path / "out")), "id", "text") == rows(df, "id", "text")


def test_missing_spellings(spark, tmp_path):
    (tmp_path / "in.csv").write_text('TransactionID,dist1,note\n1,NA,"NA"\n2,1.5,none\n3,,plain\n')
    found = tables.read_csv(spark, str(tmp_path / "in.csv"), missing=["NA", "none"])
    assert rows(found) == [(1, None, None), (2, 1.5, None), (3, None, "plain")]



@pytest.mark.parametrize("compression", ["snappy", "gzip", "none"])
def test_partitioned_write_keeps_null_and_odd_keys(spark, tmp_path, compression):
    (tmp_path / "in.csv").write_text("k,v\n01,1\na/b,2\n,3\n01,4\n")
    out = str(tmp_path / "out")
    n = tables.write_partitioned(spark, str(tmp_path / "in.csv"), out, ["k"], compression=compression, types={"v": "bigint"})
    assert n == 3
    back = spark.read.schema("v bigint, k string").parquet(out)
    assert rows(back, "k", "v") == [(None, 3), ("01", 1), ("01", 4), ("a/b", 2)]


def test_partitioned_write_arguments(spark, tmp_path):
    (tmp_path / "in.csv").write_text("k,v\n1,1\n")
    with pytest.raises(ValueError, match="partition columns"):
        tables.write_partitioned(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), ["gone"])
    with pytest.raises(ValueError):
        tables.write_parquet(spark.range(1), str(tmp_path / "out"), rows_per_file=0)


def test_preset_columns():
    assert len(CATEGORICAL_FEATURES) == 36 and len(USED_FEATURES) == 60
    assert [n for n in CATEGORICAL_FEATURES if n not in USED_FEATURES] == []
    schema = tables.raw_schema(["TransactionID", "card1", "C1", "V339", "id-01", "id_12", "P_emaildomain", "M1", "dist1"])
    assert schema == (
        "`TransactionID` bigint, `card1` string, `C1` double, `V339` double, `id-01` double, "
        "`id_12` string, `P_emaildomain` string, `M1` string, `dist1` double"
    )


# -- artefacts and examples ------------------------------------------------------------------------
def test_mapping_documents(spark, tmp_path, tables=None):
    df = spark.range(100).select((F.col("id") % 7).cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    mapping = fit_category_mapping(df, ["a", "b"])
    artefacts.write_mapping_json(mapping, str(tmp_path / "one"))
    artefacts.write_mapping_json(mapping, str(tmp_path / "many"), values_per_document=10)
    assert rows(artefacts.read_mapping_json(spark, str(tmp_path / "one"))) == rows(mapping)
    assert rows(artefacts.read_mapping_json(spark, str(tmp_path / "many"))) == rows(mapping)
    assert spark.read.text(str(tmp_path / "many")).count() > spark.read.text(str(tmp_path / "one")).count() == 2


def test_mapping_document_by_hand(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        '{"column": "c", "mapping": {"x": {"count": 3, "cumulative_count": 3, "cumulative_percentage": 75.0, "category": "x"}}}'
    )
    assert rows(artefacts.read_mapping_json(spark, [str(tmp_path / "c.json")])) == [("c", "x", 3, 3, 75.0, "x")]


def test_settings(spark, tmp_path):
    settings = {"features": ["a", "b"], "params": {"depth": 3}, "seed": 42, "none": None}
    artefacts.write_settings(spark, settings, str(tmp_path / "s"))
    assert artefacts.read_settings(spark, str(tmp_path / "s")) == settings


def test_examples_defaults(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5, True), (None, None, None, None), (3, "c", float("nan"), False)], "i int, s string, x double, b boolean")
    examples.write_examples(df, ["s", "x", "i", "b"], str(tmp_path / "e"))
    back = examples.read_examples(spark, str(tmp_path / "e"))
    assert back.dtypes == [("s", "string"), ("x", "double"), ("i", "bigint"), ("b", "bigint")]
    assert rows(back) == [("", 0.0, 0, 0), ("a", 2.5, 1, 1), ("c", 0.0, 3, 0)]


def test_unknown_example_type(spark, tmp_path):
    spark.createDataFrame([(0, "a", "complex")], "position int, name string, example_type string").write.json(str(tmp_path / "features"))
    with pytest.raises(TypeError):
        examples.read_examples(spark, str(tmp_path))
