"""Steps as Spark ML stages, and contextual row vectors."""

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from conftest import rows
from riskflow.operators import context, stages


@pytest.fixture(scope="module")
def cases(spark):
    i = F.col("id")
    c = F.when(i % 3 == 0, "hot").when(i % 50 == 1, F.concat(F.lit("rare"), i.cast("string"))).otherwise("mid")
    return spark.range(300).select("id", ((i * 37) % 100).cast("double").alias("x"), c.alias("c"), ((i * 37) % 100 > 55).cast("int").alias("y")).cache()


def steps(**options):
    trees = stages.BoostedTrees(categorical=["c"], numeric=["x"], label="y", maxIter=2, maxDepth=2, **options)
    return [stages.CategoryGrouping(columns=["c"], share=98.8, other="few"), stages.StandardScaling(exclude=["id", "y"]), trees]


def test_pipeline_is_fitted_saved_and_loaded(spark, cases, tmp_path):
    pipeline = Pipeline(stages=steps())
    pipeline.write().overwrite().save(str(tmp_path / "p"))
    model = Pipeline.load(str(tmp_path / "p")).fit(cases)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    out = loaded.transform(cases)
    assert rows(out, "id", "score", "predicted") == rows(model.transform(cases), "id", "score", "predicted")
    assert {r["c"] for r in out.select("c").distinct().collect()} == {"hot", "mid", "few"}
    assert abs(out.agg(F.avg("x")).first()[0]) < 1e-9
    assert loaded.stages[2].get("maxIter") == 2 and loaded.stages[0].get("other") == "few"
    assert stages.ScoreEvaluator(label="y").evaluate(out) > 0.99
    assert stages.ScoreEvaluator(label="y", metric="accuracy", score="predicted").evaluate(out) > 0.95


def test_cross_validation_over_the_stages(cases):
    pipeline = Pipeline(stages=steps())
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[2].maxDepth, [1, 3]).build()
    found = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=stages.ScoreEvaluator(label="y"), numFolds=2, seed=1).fit(cases)
    assert len(found.avgMetrics) == 2 and all(0.9 < m <= 1 for m in found.avgMetrics)
    assert "score" in found.transform(cases).columns


def test_evaluator_direction_and_names():
    assert stages.ScoreEvaluator().isLargerBetter() and not stages.ScoreEvaluator(metric="ece").isLargerBetter()


def test_context_takes_in_the_other_tokens(spark):
    made = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", "z")]
    df = spark.createDataFrame(made, "p string, q string").withColumn(
        "tokens", F.array(F.struct(F.lit("p").alias("column"), F.col("p").alias("value")), F.struct(F.lit("q").alias("column"), F.col("q").alias("value")))
    )
    pairs = context.token_pairs(df, "tokens")
    weights = {(r["a"]["value"], r["b"]["value"]): r["weight"] for r in pairs.collect()}
    assert weights["a", "x"] == weights["x", "a"] == pytest.approx(math.log(5 * 2 / (3 * 2)))
    assert ("a", "y") not in weights  # 5 x 1 / (3 x 2) is below 1
    vectors = spark.createDataFrame([("p", "a", [1.0, 0.0]), ("p", "b", [0.0, 1.0]), ("q", "x", [2.0, 2.0]), ("q", "z", [4.0, 0.0])], "column string, value string, vector array<double>")
    found = {tuple(t["value"] for t in r["tokens"]): r["vector"] for r in context.context_vectors(df, "tokens", pairs, vectors, 2).collect()}
    w = weights["a", "x"]
    assert found["a", "x"] == pytest.approx([(1 + 2 + w * (1 + 2)) / 2, (0 + 2 + w * (0 + 2)) / 2])
    assert found["a", "y"] == pytest.approx([0.5, 0.0])  # y has no vector, and no weight with a
    assert len(found) == 4
