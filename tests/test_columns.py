import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from riskflow.functions import scalars
from riskflow.operators import columns


def test_columns_by_type_and_name(spark):
    df = spark.createDataFrame([], "id_01 double, id_12 string, id_x string, card1 int, flag boolean")
    assert columns.numeric_columns(df, exclude=["card1"]) == ["id_01", "flag"]
    assert columns.text_columns(df) == ["id_12", "id_x"]
    assert columns.columns_of_type(df, T.DoubleType) == ["id_01"]
    assert columns.columns_numbered(df, "id_", 11) == ["id_12"]
    assert columns.columns_matching(df, r"^id_\d+$") == ["id_01", "id_12"]


def test_feature_order():
    assert columns.feature_order(["c", "a", "z"], ["a", "b", "c"], ["c", "b"]) == (["c"], ["a"])


def test_select_features(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, `c.d` int")
    assert columns.select_features(df, ["c.d", "a"], "b").columns == ["c.d", "a", "b"]
    with pytest.raises(ValueError, match="zz"):
        columns.select_features(df, ["zz"])


def test_text_of_codes_and_missing(spark):
    df = spark.createDataFrame([(321, 1.5), (None, None)], "c int, x double")
    assert rows(columns.categories_to_text(df, ["c", "x", "gone"])) == [("321", "1.5"), ("nan", "nan")]
    assert rows(columns.categories_to_text(df, ["c"], None).select("c")) == [(None,), ("321",)]


def test_coerce_fill_and_defaults(spark):
    df = spark.createDataFrame([("1.5", 2), ("x", None), ("nan", 3), (None, 4)], "n string, i int")
    assert rows(columns.coerce_numeric(df, ["n"]), "i", "n") == [(None, 0.0), (2, 1.5), (3, 0.0), (4, 0.0)]
    assert rows(columns.coerce_numeric(df, ["n"], None).where("i = 3"), "n") == [(None,)]
    assert rows(columns.fill_by_type(df).where("i = 0")) == [("x", 0)]
    assert columns.with_defaults(df, {"n": F.lit("q"), "k": F.lit(7)}).first()["k"] == 7


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (1.0, 2)], "x double, i int")
    assert rows(columns.nan_as_null(df)) == [(None, 1), (1.0, 2)]
    assert columns.nan_as_null(df.select("i")).columns == ["i"]


def test_target(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert rows(columns.add_target_if_absent(df, "t")) == [(1, -1)]
    assert columns.add_target_if_absent(df, "a").columns == ["a"]
    labels = spark.createDataFrame([("1",), ("0",), ("x",), (None,)], "t string")
    assert [r[0] for r in labels.select(scalars.to_integer("t")).collect()] == [1, 0, None, None]


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("id_12", "a-b-c", "Chunk_000012.PARQUET")], "name string, dashed string, file string")
    r = df.select(
        scalars.suffix_number("name", "id_"), scalars.suffix_number("dashed", "id_"), scalars.underscored("dashed"),
        scalars.file_suffix("file"), scalars.extract_integer("file", r"(\d+)"), scalars.zero_padded(F.lit(7)),
        scalars.matches("file", "chunk"), scalars.file_suffix("name"),
    ).first()
    assert tuple(r) == (12, None, "a_b_c", ".parquet", 12, "000007", True, "")


def test_schema_report(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert rows(columns.describe_schema(df, "t")) == [("t", 1, "i", "int", 2), ("t", 2, "s", "string", 2)]
