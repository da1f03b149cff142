from pyspark.sql import functions as F
import pytest

from conftest import rows
from riskflow.operators import assemble, scaling
from riskflow.operators.categorical import (
    apply_category_mapping,
    cardinalities,
    encode_vocabulary,
    fit_category_mapping,
    fit_vocabulary,
)


def values(spark, *pairs):
    return spark.createDataFrame([(v,) for v, n in pairs for _ in range(n)], "c string")


def test_mapping_keeps_values_within_the_share(spark):
    df = values(spark, ("a", 60), ("b", 30), ("c", 6), ("d", 4))
    found = [tuple(r) for r in fit_category_mapping(df, ["c"]).orderBy("cumulative_count").collect()]
    assert [(v, n, upto, cat) for _, v, n, upto, _, cat in found] == [
        ("a", 60, 60, "a"), ("b", 30, 90, "b"), ("c", 6, 96, "Other"), ("d", 4, 100, "Other"),
    ]
    assert [round(p, 9) for *_, p, _ in found] == [60.0, 90.0, 96.0, 100.0]


def test_dominant_value_is_other_itself(spark):
    mapping = fit_category_mapping(values(spark, ("a", 95), ("b", 5)), ["c"])
    assert {r["value"]: r["category"] for r in mapping.collect()} == {"a": "Other", "b": "Other"}


def test_ties_go_by_value_and_nulls_count_as_nan(spark):
    mapping = fit_category_mapping(values(spark, ("b", 2), ("a", 2), (None, 3)), ["c"])
    assert [r["value"] for r in mapping.orderBy("cumulative_count").collect()] == ["nan", "a", "b"]
    without = fit_category_mapping(values(spark, ("b", 2), (None, 3)), ["c"], null_token=None)
    assert [r["value"] for r in without.collect()] == ["b"]


def test_mapping_range_path(tables):
    orders = tables("orders")
    small = rows(fit_category_mapping(orders, ["o_custkey", "o_orderpriority"]))
    assert rows(fit_category_mapping(orders, ["o_custkey", "o_orderpriority"], single_task_rows=10)) == small


@pytest.mark.parametrize("options", [{}, {"literal_values": 0}, {"literal_values": 0, "broadcast_rows": 0}])
def test_apply_mapping_paths_agree(spark, options):
    mapping = fit_category_mapping(values(spark, ("a", 50), ("b", 35), (None, 10), ("z", 5)), ["c"], share=96.0)
    scored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "new"), (4, None), (5, "z")], "id int, c string")
    out = apply_category_mapping(scored, mapping, ["c"], **options)
    assert out.columns == ["id", "c"]
    assert rows(out) == [(1, "a"), (2, "b"), (3, "Other"), (4, "nan"), (5, "Other")]


def test_renaming_mapping(spark):
    mapping = spark.createDataFrame([("c", "a", 3, 3, 60.0, "A"), ("c", "b", 2, 5, 100.0, "Other")],
        "column string, value string, count bigint, cumulative_count bigint, cumulative_percentage double, category string")
    df = spark.createDataFrame([("a",), ("b",), ("x",)], "c string")
    assert sorted(r[0] for r in apply_category_mapping(df, mapping, ["c"]).collect()) == ["A", "Other", "Other"]


def test_mapping_of_a_column_without_entries(spark):
    mapping = fit_category_mapping(values(spark, ("a", 1)), ["c"])
    df = spark.createDataFrame([("x", "y")], "c string, other string")
    assert rows(apply_category_mapping(df, mapping, ["c", "other"])) == [("Other", "Other")]


def test_grouping_and_scaling_are_stateless_on_a_stream(spark, tmp_path, tables):
    orders = tables("orders")
    orders.write.parquet(str(tmp_path / "in"))
    mapping = fit_category_mapping(orders, ["o_orderpriority"])
    fitted = scaling.fit_scaling(orders, ["o_totalprice"])
    stream = spark.readStream.schema(orders.schema).parquet(str(tmp_path / "in"))
    shaped = scaling.apply_scaling(apply_category_mapping(stream, mapping, ["o_orderpriority"]), fitted)
    sink = shaped.select("o_orderkey", "o_orderpriority", "o_totalprice").writeStream.format("memory").queryName("shaped")
    running = sink.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(60)
    batch = scaling.apply_scaling(apply_category_mapping(orders, mapping, ["o_orderpriority"]), fitted)
    assert rows(spark.table("shaped")) == rows(batch, "o_orderkey", "o_orderpriority", "o_totalprice")


def test_vocabulary_starts_at_one_and_ties_go_to_later_text(spark):
    vocabulary = fit_vocabulary(values(spark, ("a", 2), ("b", 2), ("c", 5), (None, 9)), ["c"])
    assert [(r["token"], r["index"]) for r in vocabulary.orderBy("index").collect()] == [("c", 1), ("b", 2), ("a", 3)]
    assert rows(cardinalities(vocabulary)) == [("c", 4)]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_encoding_unknown_null_and_absent(spark, broadcast_rows):
    vocabulary = fit_vocabulary(values(spark, ("a", 2), ("b", 1)), ["c"])
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "x"), (4, "b")], "id int, c string")
    out = encode_vocabulary(df, vocabulary, ["c", "absent"], broadcast_rows=broadcast_rows)
    assert rows(out, "id", "c_index", "absent_index") == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 2, 0)]


def test_encoded_rows(spark):
    vocabulary = fit_vocabulary(values(spark, ("a", 2)), ["c"])
    df = spark.createDataFrame([("a", "1.5"), ("q", "junk"), ("a", None)], "c string, n string")
    out = assemble.encode_rows(df, vocabulary, ["c"], ["n", "gone"])
    assert dict(out.dtypes)["categorical_features"] == "array<int>"
    assert sorted((list(r[0]), list(r[1])) for r in out.select("categorical_features", "numeric_features").collect()) == [
        ([0], [0.0, 0.0]), ([1], [0.0, 0.0]), ([1], [1.5, 0.0]),
    ]
    nothing = assemble.encode_rows(df, vocabulary, [], [])
    assert list(nothing.first()["categorical_features"]) == [] and list(nothing.first()["numeric_features"]) == []


def test_array_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],), ([],)], "v array<float>")
    out = assemble.spread_array(df, "v", "p", 2).select(assemble.array_mean("v").alias("m"), "p0", "p1")
    assert rows(out) == [(None, None, None), (3.0, 1.0, 2.0)]


def test_scaling_constant_column_and_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (float("nan"), 5.0), (None, 5.0)], "x double, k double")
    fitted = scaling.fit_scaling(df)
    assert fitted.parameters["x"] == (2.0, pytest.approx(2**0.5))
    out = rows(scaling.apply_scaling(df, fitted))
    assert [x for x, _ in out] == [None, None, pytest.approx(-(0.5**0.5)), pytest.approx(0.5**0.5)]
    assert all(k is None for _, k in out)


def test_scaling_uses_training_statistics(spark):
    train = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    test = spark.createDataFrame([(4.0,)], "x double")
    assert scaling.apply_scaling(test, scaling.fit_scaling(train)).first()[0] == pytest.approx(3 / 2**0.5)


def test_scaling_table_round_trip(spark):
    fitted = scaling.Scaling({"a": (1.0, 2.0), "b": (None, None)})
    assert scaling.Scaling.from_table(fitted.table(spark)) == fitted


def test_grouping_plan_reads_only_selected_columns(tables):
    orders = tables("orders")
    mapping = fit_category_mapping(orders, ["o_orderpriority"])
    out = apply_category_mapping(orders, mapping, ["o_orderpriority"]).select("o_orderpriority")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderpriority:string>" in plan and "Exchange" not in plan


def test_mapping_of_near_unique_column_with_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr("riskflow.operators.ordering.ROWS_PER_RANGE", 200)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    mapping = fit_category_mapping(df, ["c"], single_task_rows=100)
    first = mapping.orderBy("cumulative_count").first()
    assert (first["value"], first["count"]) == ("hot", 1000)
    last = mapping.orderBy(F.desc("cumulative_count")).first()
    assert last["cumulative_count"] == 3000 and mapping.count() == 2001
