"""Models, embeddings, search and user functions, by their properties."""

import math
import time

import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from conftest import rows
from riskflow import session
from riskflow.functions.losses import focal_terms
from riskflow.operators import boosting, embeddings, metrics, models, rates
from riskflow.operators.boosting import NewtonBoostedClassifier, loss_by_round
from riskflow.operators.partition import BatchStep, TableStep, apply_batches, score_batches
from riskflow.operators.sampling import split_rows
from riskflow.operators.tuning import RandomSearch
from riskflow.plans.embedding import append_embeddings, write_splits
from riskflow.plans.features import FeatureSteps, fit_features, write_processed
from riskflow.plans.training import TrainingResult, train_and_judge
from riskflow.registry import modelling

SMALL = {"maxIter": 3, "maxDepth": 3, "seed": 1}


@pytest.fixture(scope="module")
def cases(spark):
    """A target that follows a number and a category; some numbers missing."""
    i = F.col("id")
    x = F.when(i % 11 == 0, None).otherwise((i * 37 % 100) / 100.0)
    c = F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (i % 5).cast("string")))
    y = ((F.coalesce(x, F.lit(0.9)) > 0.6) | (c == "c1")).cast("int")
    return spark.range(600).select("id", x.alias("x"), c.alias("c"), y.alias("y")).cache()


@pytest.fixture(scope="module")
def fitted(cases):
    return models.BoostedTreesClassifier(["c"], ["x"], "y", **SMALL).fit(cases)


def test_scores_separate(fitted, cases):
    scored = fitted.predict_proba(cases)
    assert scored.columns == [*cases.columns, "score"]
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert fitted.evaluate(cases, "roc_auc") > 0.95
    assert fitted.evaluate(cases, "accuracy") > 0.9
    assert metrics.roc_auc(fitted.margins(cases), "y", "margin").first()[0] > 0.95


def test_same_seed_same_scores(fitted, cases):
    again = models.BoostedTreesClassifier(["c"], ["x"], "y", **SMALL).fit(cases)
    assert rows(again.predict_proba(cases), "id", "score") == rows(fitted.predict_proba(cases), "id", "score")


def test_save_and_load(fitted, cases, tmp_path):
    fitted.save(str(tmp_path / "m"))
    fitted.save(str(tmp_path / "m"))
    loaded = models.BoostedTreesClassifier.load(str(tmp_path / "m"))
    assert loaded._config() == fitted._config()
    assert rows(loaded.predict_proba(cases), "id", "score") == rows(fitted.predict_proba(cases), "id", "score")


def test_unseen_category_is_scored(fitted, spark):
    new = spark.createDataFrame([(1, 0.5, "never seen"), (2, None, None)], "id int, x double, c string")
    assert fitted.predict(new).where("prediction IS NOT NULL").count() == 2


def test_importances(fitted):
    found = fitted.importances().collect()
    assert [r["feature_importance_rank"] for r in found] == list(range(1, 4))
    assert sum(r["feature_importance"] for r in found) == pytest.approx(1.0)
    assert found[-1]["cumulative_importances"] == pytest.approx(1.0)
    assert found[0]["feature_name"] == "x"
    assert fitted.importances(top=1).count() == 1


def test_guards(cases):
    unfitted = models.BoostedTreesClassifier(["c"], ["x"], "y")
    with pytest.raises(RuntimeError):
        unfitted.predict(cases)
    with pytest.raises(RuntimeError):
        unfitted.predict_proba(cases)
    with pytest.raises(ValueError):
        unfitted.evaluate(cases, "f2")
    with pytest.raises(ValueError):
        models.BoostedTreesRegressor([], ["x"], "y").evaluate(cases, "roc_auc")
    with pytest.raises(ValueError):
        models.BoostedTreesClassifier(frequency=["c"])


def test_many_categories_need_an_encoding(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 200).cast("string").alias("c"), (F.col("id") % 2).cast("int").alias("y"))
    with pytest.raises(ValueError, match="frequency"):
        models.BoostedTreesClassifier(["c"], [], "y", max_bins=100, **SMALL).fit(df)
    exact = models.BoostedTreesClassifier(["c"], [], "y", max_bins=200, **SMALL).fit(df)
    assert exact.evaluate(exact.transform(df), "accuracy") == 1.0
    skewed = df.where("id < 200 OR id % 3 = 0")
    model = models.BoostedTreesClassifier(["c"], [], "y", frequency=["c"], max_bins=8, **SMALL).fit(skewed)
    model.save(str(tmp_path / "m"))
    loaded = models.BoostedTreesClassifier.load(str(tmp_path / "m"))
    scored = loaded.predict_proba(df.unionByName(df.limit(1).withColumn("c", F.lit("unseen"))))
    assert scored.where("score IS NULL").count() == 0 and scored.count() == 401


def test_regressor(cases):
    model = models.BoostedTreesRegressor(["c"], ["x"], "y", **SMALL).fit(cases)
    assert model.evaluate(cases) < 0.1
    assert model.predict(model.predict(cases)).columns == [*cases.columns, "prediction"]


def test_early_stopping_uses_fewer_rounds(cases):
    flagged = split_rows(cases, "id").withColumn("held", F.col("set") == "validation")
    long = models.BoostedTreesClassifier(["c"], ["x"], "y", validation="held", validationTol=0.2, maxIter=15, maxDepth=3, seed=1)
    assert long.fit(flagged).rounds < 15


@pytest.mark.parametrize("balance", ["weights", "undersample", None])
def test_train_and_judge(spark, cases, tmp_path, balance):
    unknown = cases.limit(5).withColumn("y", F.lit(-1)).withColumn("id", F.col("id") + 10000)
    result = train_and_judge(cases.unionByName(unknown), "id", "y", ["c"], ["x"], balance=balance, **SMALL)
    found = {r["set"]: r for r in result.metrics.collect()}
    assert set(found) == {"train", "validation"}
    assert all(r["roc_auc"] > 0.9 and 0 <= r["ece"] <= 1 for r in found.values())
    assert result.scored.count() == 600
    assert result.report("validation").where("label = 'accuracy'").first()["f1_score"] > 0.9
    assert result.score(cases).where("calibrated BETWEEN 0 AND 1").count() == 600
    if balance is None:
        result.write(spark, str(tmp_path / "run"))
        stored = TrainingResult.read(spark, str(tmp_path / "run"))
        assert rows(stored.score(cases), "id", "score", "calibrated") == rows(result.score(cases), "id", "score", "calibrated")
        assert stored.label == "y" and stored.metrics.count() == 2


def test_train_arguments(cases):
    with pytest.raises(ValueError):
        train_and_judge(cases, "id", "y", ["c"], ["x"], balance="other")


# -- registered queries ----------------------------------------------------------------------------------
def test_early_stop_query_ends_below_its_limit(spark, folder):
    found = modelling.gbt_early_stop(spark, folder).collect()
    assert {r["set"] for r in found} == {"train", "validation"}
    assert all(3 <= r["rounds"] < models.TRAINING_PARAMS["maxIter"] and r["roc_auc"] > 0.99 for r in found)


def test_model_queries_learn_their_targets(spark, folder):
    scored = modelling.gbt_scores(spark, folder)
    truth = modelling.valuable_lines(spark, folder).select(*modelling.LINE_KEY, "valuable")
    right = scored.join(truth, modelling.LINE_KEY).where(F.col("prediction") == F.col("valuable")).count()
    assert right > 0.98 * truth.count() == 0.98 * scored.count()
    off = modelling.gbt_regression(spark, folder).agg(F.avg(F.abs(F.col("charge") - F.col("prediction"))), F.avg("charge")).first()
    assert off[0] < 0.15 * off[1]


# -- Newton boosting -------------------------------------------------------------------------------------
def _wide(spark, times):
    """2,000 rows with 1,000 values of a number, ``times`` times."""
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / F.lit(7.0)
    rows = spark.range(2000).select(x.alias("x"), (F.col("id") % 3).cast("string").alias("c"), F.lit(0.5 * times).alias("unused"))
    rows = rows.withColumn("y", (F.col("x") + F.when(F.col("c") == "1", 20).otherwise(0) > 80).cast("int")).withColumn("z", F.col("x") * 2 + F.col("y"))
    return rows.withColumn("held", F.pmod(F.xxhash64("x"), F.lit(4)) == 0).crossJoin(spark.range(times).select(F.col("id").alias("copy")))


@pytest.mark.parametrize("kind", ["classifier", "regressor", "newton"])
def test_training_rows_are_bounded_by_what_trees_tell_apart(spark, kind):
    def model():
        options = {"max_bins": 32, "validation": "held"}
        if kind == "newton":
            return NewtonBoostedClassifier(["c"], ["x"], "y", rounds=3, depth=3, **options)
        made = models.BoostedTreesClassifier if kind == "classifier" else models.BoostedTreesRegressor
        return made(["c"], ["x"], "y" if kind == "classifier" else "z", **options, **SMALL)

    once, often = _wide(spark, 1), _wide(spark, 5)
    tables = [model()._training_table(df)[0] for df in (once, often)]
    assert tables[0].count() == tables[1].count() <= 32 * 3 * 2 * 2
    assert [t.agg(F.round(F.sum("_weight"), 6)).first()[0] for t in tables] == [2000, 10000]
    score = "prediction" if kind == "regressor" else "score"
    scored = [rows((m.predict(once) if kind == "regressor" else m.predict_proba(once)), "x", "c", score) for m in (model().fit(once), model().fit(often))]
    assert [r[-1] for r in scored[0]] == pytest.approx([r[-1] for r in scored[1]], abs=1e-9)


@pytest.mark.parametrize("kind", [models.BoostedTreesClassifier, NewtonBoostedClassifier])
def test_a_training_task_holds_few_rows(spark, monkeypatch, kind):
    """However small the files are: a scan would read all of these in one task or two."""
    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    found = []

    def train(self, table, stages, bins):
        found.extend(r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect())
        return PipelineModel([])

    monkeypatch.setattr(kind, "_train", train)
    kind(["c"], ["x"], "y", max_bins=1000, validation="held").fit(_wide(spark, 3).coalesce(1))
    assert max(found) <= 200 and len(found) >= 10


def test_grouped_regression_rows_keep_their_moments(spark):
    rows_ = _wide(spark, 1)
    model = models.BoostedTreesRegressor(["c"], ["x"], "z", max_bins=32, **SMALL)
    table = model._training_table(rows_)[0]
    z, w = F.col("_label"), F.col("_weight")
    found = table.agg(F.sum(w), F.sum(w * z), F.sum(w * z * z)).first()
    assert list(found) == pytest.approx(list(rows_.agg(F.count("*"), F.sum("z"), F.sum(F.col("z") * F.col("z"))).first()))
    # As good as the deviation within a range allows: a tree on all rows can't be better by more than that.
    assert model.fit(rows_).evaluate(rows_) < rows_.agg(F.var_pop("z")).first()[0]


def test_cuts_keep_a_frequent_value_apart(spark):
    often = spark.range(100_000).select(F.lit(500.0).alias("x")).unionByName(spark.range(1000).select((F.col("id") / 1.0).alias("x")))
    cuts = models.value_cuts(often, ["x"], 16)["x"]
    assert len(cuts) < 16 and cuts == sorted(set(cuts)) and {500.0, 501.0} <= set(cuts)
    assert models.value_cuts(often, ["x"], 1001) == {}


def test_newton_rounds_lower_the_focal_loss(spark, cases, tmp_path):
    model = NewtonBoostedClassifier(["c"], ["x"], "y", rounds=10, depth=3, step=0.3, penalty=0.5).fit(cases)
    losses = [h["train"] for h in model.history]
    assert len(losses) == model.rounds == 10 and all(b < a for a, b in zip(losses, losses[1:]))
    assert model.evaluate(cases, "loss") == pytest.approx(losses[-1])
    assert model.evaluate(cases, "accuracy") > 0.9 and model.evaluate(cases) > 0.95
    assert loss_by_round(model).count() == 10
    model.save(str(tmp_path / "n"))
    loaded = NewtonBoostedClassifier.load(str(tmp_path / "n"))
    assert rows(loaded.predict_proba(cases), "id", "score") == rows(model.predict_proba(cases), "id", "score")
    named = cases.withColumn("margin", F.lit(7)).withColumn("score", F.lit(8))
    assert model.margins(named, "z").columns == [*named.columns, "z"]
    assert model.predict_proba(named, "z").select("margin", "score").distinct().collect() == [(7, 8)]


def test_newton_stops_with_its_held_out_rows(cases):
    flagged = split_rows(cases, "id").withColumn("held", F.col("set") == "validation")
    model = NewtonBoostedClassifier(["c"], ["x"], "y", rounds=40, depth=4, step=1.0, patience=1, validation="held").fit(flagged)
    held = [h["validation"] for h in model.history]
    assert model.rounds == held.index(min(held)) + 1 <= len(held)
    assert len(held) == 40 or model.rounds == len(held) - 1


def test_newton_rounds_read_blocks_of_codes(spark, monkeypatch):
    """A round used to read a row for each group several times."""
    written = []

    def counted(df, label="table", path=None):
        table = session.materialise(df, label, path)
        written.append(table.count())
        return table

    monkeypatch.setattr(boosting, "materialise", counted)
    wide = _wide(spark, 1)
    model = NewtonBoostedClassifier(["c"], ["x"], "y", rounds=2, depth=3, max_bins=1000, validation="held").fit(wide)
    assert max(written[-2:]) <= 8 < 1000 < wide.distinct().count()
    # A loss made of columns takes the blocks apart and gives the same.
    own = NewtonBoostedClassifier(["c"], ["x"], "y", rounds=2, depth=3, max_bins=1000, validation="held", terms=lambda y, z: focal_terms(y, z)).fit(wide)
    assert [list(h.values()) for h in own.history] == [pytest.approx(list(h.values()), rel=1e-9) for h in model.history]
    assert max(written[-2:]) <= 8
    with pytest.raises(ValueError, match="label is missing"):
        NewtonBoostedClassifier(["c"], ["x"], "y", rounds=1).fit(wide.withColumn("y", F.when(F.col("x") > 5, F.col("y"))))
    with pytest.raises(ValueError, match="no rows"):
        NewtonBoostedClassifier([], ["x"], "y", rounds=1).fit(wide.limit(0))
    flat = NewtonBoostedClassifier([], ["unused"], "y", rounds=1).fit(wide)  # nothing to split by
    assert flat.margins(wide).select("margin").distinct().count() == 1


def test_newton_trees_are_those_of_a_weighted_regression_tree(spark):
    wide = _wide(spark, 1).withColumn("v", F.floor(F.col("x") * 7) % 13).drop("held")
    g, h = focal_terms(F.col("y").cast("double"), F.lit(0.5))
    single = wide.withColumn("target", -g / h).withColumn("mass", h)
    indexed = StringIndexer(inputCol="c", outputCol="i", stringOrderType="alphabetAsc").fit(single).transform(single)
    vectors = VectorAssembler(inputCols=["i", "x", "v"], outputCol="features").transform(indexed)
    tree = DecisionTreeRegressor(labelCol="target", weightCol="mass", maxDepth=4, maxBins=1000).fit(vectors)
    model = NewtonBoostedClassifier(["c"], ["x", "v"], "y", rounds=1, step=1.0, depth=4, start=0.5, max_bins=1000).fit(wide)
    found = model.margins(tree.transform(vectors), "margin").select("margin", "prediction").distinct().collect()
    assert len(found) > 4 and all(r["margin"] - 0.5 == pytest.approx(r["prediction"], abs=1e-9) for r in found)


def test_newton_takes_a_loss_of_ones_own(cases):
    def squared(label, margin):
        return margin - label, F.lit(1.0)

    model = NewtonBoostedClassifier((), ["x"], "y", terms=squared, loss=lambda y, p: F.pow(y - p, F.lit(2.0)), rounds=1, depth=1, step=1.0).fit(cases)
    means = {round(r["margin"], 6) for r in model.margins(cases).collect()}
    filled = cases.select("y", F.coalesce("x", F.lit(0.0)).alias("x"), F.col("x").isNull().alias("m")).toPandas()
    best = min(
        ((filled["x"] <= cut) if name == "x" else ~filled["m"] for name, cut in [*(("x", v) for v in filled["x"].unique()), ("m", 0)]),
        key=lambda low: sum(((p - p.mean()) ** 2).sum() for p in (filled["y"][low], filled["y"][~low])),
    )
    assert means == {round(filled["y"][best].mean(), 6), round(filled["y"][~best].mean(), 6)}
    with pytest.raises(ValueError):
        NewtonBoostedClassifier((), ["x"], "y", step=0.0)
    with pytest.raises(RuntimeError):
        NewtonBoostedClassifier((), ["x"], "y").transform(cases)


# -- rates by fold -----------------------------------------------------------------------------------------
def test_out_of_fold_rates(spark):
    made = [(i % 3, i % 2 if i % 5 else 1, "a" if i % 4 else f"v{i}") for i in range(60)]
    df = spark.createDataFrame(made, "fold int, y int, c string").withColumn("d", F.lit("one"))
    found = rows(rates.out_of_fold_scores(df, "fold", "y", ["c", "d"], 2.0))
    coded = df.withColumn("e", F.when(F.col("c") == "a", 61).otherwise(F.substring("c", 2, 9).cast("int"))).withColumn("g", F.lit(3))
    both = rates.out_of_fold_scores(rates.out_of_fold_scores(coded, "fold", "y", ["c", "d"], 2.0, "s"), "fold", "y", ["e", "g"], 2.0, "t")
    assert both.where(F.abs(F.col("s") - F.col("t")) < 1e-12).count() == 60

    def score(fold, c):
        others = [m for m in made if m[0] != fold]
        share = sum(m[1] for m in others) / len(others)
        same = [m for m in others if m[2] == c]
        return ((sum(m[1] for m in same) + 2 * share) / (len(same) + 2) + (sum(m[1] for m in others) + 2 * share) / (len(others) + 2)) / 2

    assert [r[:4] for r in found] == sorted((f, y, c, "one") for f, y, c in made)
    assert all(r[4] == pytest.approx(score(r[0], r[2])) for r in found)
    with pytest.raises(ValueError):
        rates.out_of_fold_scores(df, "fold", "y", ["c"], -1.0)


def test_errors_of_grouped_rows_are_those_of_the_rows(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 7 < 3).cast("int").alias("y"), (F.col("id") % 4).alias("a"), F.concat(F.lit("v"), F.col("id") % 5).alias("b"))
    grouped = rates.grouped_rows(df, "fold", "y", ["a", "b"])
    assert grouped.count() <= 3 * 2 * 4 * 5
    coarse = rates.grouped_rows(grouped, "fold", "y", ["a"], "_weight")
    assert coarse.agg(F.sum("_weight")).first()[0] == 3000
    key = lambda r: (r["fold"], r["column"], r["value"])
    assert sorted(rates.bounded_counts(grouped, "fold", "y", ["a", "b"], "_weight"), key=key) == sorted(rates.bounded_counts(df, "fold", "y", ["a", "b"]), key=key)
    whole = rates.out_of_fold_error(df, "fold", "y", ["a", "b"], 2.0)
    assert rates.out_of_fold_error(grouped, "fold", "y", ["a", "b"], 2.0, weight="_weight") == pytest.approx(whole, abs=1e-12)


def test_quantile_bins_hold_equal_shares(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(None,), (float("nan"),)], "x double")
    binned = rates.binned(df, ["x"], [], [5, 3], ["x"])
    assert rows(binned.groupBy("bin_5_x").count()) == [(0, 20), (1, 20), (2, 20), (3, 20), (4, 20), (5, 2)]
    assert {r["bin_3_x"] for r in binned.where("x = 3").collect()} == {0}


# -- features and embeddings ---------------------------------------------------------------------------
def test_feature_steps_are_stored_and_reused(spark, tmp_path, cases):
    train, test = cases.where("id < 400"), cases.where("id >= 400")
    steps = fit_features(train, ["x", "c"], "y", ["c", "gone"], key="id")
    assert "id" not in steps.scaling.parameters and "y" not in steps.scaling.parameters
    write_processed(steps, {"train": train, "test": test}, str(tmp_path / "p"))
    steps.write(spark, str(tmp_path / "s"))
    stored = FeatureSteps(["x", "c"], "y", ["c"], None, steps.scaling).read(spark, str(tmp_path / "s"))
    assert rows(stored.transform(test)) == rows(spark.read.parquet(str(tmp_path / "p" / "test")))


def test_feature_steps_prune_columns(tables):
    lines = tables("lineitem")
    steps = fit_features(lines, ["l_tax", "l_returnflag"], None, ["l_returnflag"])
    plan = steps.transform(lines)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in plan and "Exchange" not in plan


def test_row_vectors_are_means_of_value_vectors(cases):
    encoder = embeddings.fit_row_encoder(cases, ["c"], ["x"], size=3, bins=4)
    out = encoder.transform(cases)
    assert out.columns == [*cases.columns, "encoder_emb_0", "encoder_emb_1", "encoder_emb_2"]
    assert out.count() == 600
    vectors = {(r["column"], r["value"]): r["vector"] for r in encoder.value_vectors().collect()}
    assert ("c", "hot") in vectors and ("x", "nan") in vectors
    tokens = {r["id"]: [tuple(t) for t in r["_tokens"]] for r in encoder.tokens(cases).select("id", "_tokens").collect()}
    for r in out.where("id < 40").collect():
        of = [vectors[t] for t in tokens[r["id"]]]
        for i in range(3):
            assert r[f"encoder_emb_{i}"] == pytest.approx(sum(v[i] for v in of) / len(of), abs=1e-5)


def test_row_vectors_do_not_depend_on_partitions(spark, cases, tmp_path):
    found = []
    for parts in (1, 7):
        encoder = embeddings.fit_row_encoder(cases.repartition(parts, "id"), ["c"], ["x"], size=3, bins=4)
        found.append({r["id"]: [r[f"encoder_emb_{i}"] for i in range(3)] for r in encoder.transform(cases).collect()})
    assert all(found[0][k] == pytest.approx(found[1][k], abs=1e-6) for k in found[0])
    encoder.save(str(tmp_path / "e"))
    loaded = embeddings.RowEncoder.load(spark, str(tmp_path / "e"))
    again = {r["id"]: [r[f"encoder_emb_{i}"] for i in range(3)] for r in loaded.transform(cases).collect()}
    assert again == found[1]


def test_token_counts_come_from_sets_of_tokens(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 4).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    written = {}
    original = embeddings.materialise
    monkeypatch.setattr(embeddings, "materialise", lambda table, label="table": written.setdefault(label, original(table, label)))
    encoder = embeddings.fit_row_encoder(df, ["a", "b"], size=2, rounds=1)
    assert written["tokens"].count() == 12
    found = {(r["column"], r["value"]): r["count"] for r in encoder.vectors.collect()}
    assert found == {**{("a", str(i)): 750 for i in range(4)}, **{("b", str(i)): 1000 for i in range(3)}}
    assert rows(written["pairs"].groupBy("i").agg(F.round(F.sum(F.exp("weight") - 1)).cast("int").alias("n")).groupBy("n").count(), "n", "count") == [(750, 4), (1000, 3)]


def test_every_value_has_a_vector_unless_grouping_is_asked_for(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, F.lit("a=b")).otherwise(F.col("id").cast("string")).alias("c=d"), (F.col("id") % 3).cast("string").alias("e"))
    encoder = embeddings.fit_row_encoder(df, ["c=d", "e"], size=2)
    assert encoder.value_vectors().where("column = 'c=d'").count() == 101
    few = embeddings.fit_row_encoder(df, ["c=d", "e"], size=2, group_share=85.0)
    assert {r["value"] for r in few.value_vectors().where("column = 'c=d'").collect()} >= {"a=b", "Other"}
    assert few.value_vectors().count() < 40 and few.transform(df).count() == 500


def test_append_embeddings_to_splits(spark, cases, tmp_path):
    parts = {"train": cases.where("id < 500"), "test": cases.where("id >= 500").drop("y"), "none": cases.limit(0)}
    widened, _ = append_embeddings(parts, ["c"], size=2)
    assert widened["none"].count() == 0 and "encoder_emb_1" in widened["test"].columns
    write_splits(widened, str(tmp_path / "w"))
    assert rows(spark.read.parquet(str(tmp_path / "w")).groupBy("split").count()) == [("test", 100), ("train", 500)]
    with pytest.raises(ValueError):
        append_embeddings({"test": cases}, ["c"])


# -- search ----------------------------------------------------------------------------------------
def test_search_is_seeded_and_keeps_the_best(spark):
    space = {"a": lambda rng: rng.uniform(0, 1)}
    first, second = RandomSearch(trials=6, seed=3), RandomSearch(trials=6, seed=3)
    best = first.optimize(lambda p: p["a"], space)
    assert best == second.optimize(lambda p: p["a"], space)
    assert best[1] == max(t.value for t in first.results)
    assert first.best_trial()["params"] == best[0]
    low, _ = first.optimize(lambda p: p["a"], space, "minimize")
    assert low["a"] == min(t.value for t in first.results)
    top = first.top_trials(2).collect()
    assert [r["value"] for r in top] == sorted(t.value for t in first.results)[:2]
    assert first.trials_table().count() == 6


def test_failed_trials_get_the_worst_score(spark):
    def objective(params):
        if params["n"] % 2:
            raise ArithmeticError("odd")
        return 0.5

    search, counter = RandomSearch(trials=4), iter(range(10))
    search.optimize(objective, {"n": lambda rng: next(counter)})
    assert [(r["value"], r["state"]) for r in search.trials_table().orderBy("number").collect()] == [
        (0.5, "complete"), (-1.0, "failed"), (0.5, "complete"), (-1.0, "failed"),
    ]
    search.optimize(lambda p: 1 / 0, {}, "minimize")
    assert search.best_trial()["score"] == 1e10


def test_search_stops_at_its_deadline(spark):
    search = RandomSearch(trials=50, timeout=0.0)
    search.optimize(lambda p: 1.0, {})
    assert len(search.results) == 1


def test_search_cancels_the_jobs_of_a_late_trial(spark):
    slow = F.udf(lambda v: (time.sleep(0.5), v)[1], "long")

    def objective(params):
        return float(spark.range(0, 400, 1, 8).select(F.sum(slow("id"))).first()[0])

    search = RandomSearch(trials=6, timeout=4.0, concurrent=2)
    started = time.monotonic()
    search.optimize(objective, {})
    assert time.monotonic() - started < 20  # a trial alone takes 25 seconds
    assert [t.state for t in search.results] == ["stopped", "stopped"]
    assert spark.range(10).count() == 10


def test_concurrent_trials_draw_the_same_parameters(spark):
    space = {"a": lambda rng: rng.uniform(0, 1)}
    found = []
    for concurrent in (1, 3):
        search = RandomSearch(trials=9, concurrent=concurrent)
        search.optimize(lambda p: spark.range(3).count() * p["a"], space)
        found.append([(t.number, t.params, t.value) for t in search.results])
    assert found[0] == found[1]
    with pytest.raises(ValueError):
        RandomSearch(concurrent=0)


def test_search_arguments():
    with pytest.raises(RuntimeError):
        RandomSearch().trials_table()
    with pytest.raises(RuntimeError):
        RandomSearch().best_trial()
    for bad in ({"trials": 0}, {"folds": 1}):
        with pytest.raises(ValueError):
            RandomSearch(**bad)
    with pytest.raises(ValueError):
        RandomSearch().optimize(lambda p: 0.0, {}, "sideways")


@pytest.mark.parametrize("exact", [True, False])
def test_search_over_folds_sees_every_row_once(spark, cases, exact):
    seen = []

    def train(part, params):
        return part.agg(F.avg("y")).first()[0]

    def score(model, part):
        seen.append(part.count())
        return -part.agg(F.avg(F.pow(F.col("y") - F.lit(model), F.lit(2)))).first()[0]

    search = RandomSearch(trials=1, folds=3, parallelism=3)
    _, value = search.optimize_model(cases, "y", "id", train, score, {}, exact_folds=exact)
    assert sum(seen) == 600 and len(seen) == 3 and not math.isnan(value)


# -- user functions --------------------------------------------------------------------------------
def doubled(*args):
    class Doubled(BatchStep):
        def compute_batch(self, batch):
            return pd.DataFrame({"id": batch["id"], "twice": batch["id"] * 2})

    return Doubled(*args)


def test_batch_step(spark):
    step = doubled("id bigint, twice bigint")
    assert rows(step.compute(spark.range(4))) == [(i, 2 * i) for i in range(4)]
    assert rows(step.compute(pd.DataFrame({"id": [5]}))) == [(5, 10)]
    with pytest.raises(ValueError):
        doubled().compute(spark.range(1))
    with pytest.raises(TypeError):
        step.compute([1, 2])


def test_empty_input_passes(spark):
    assert doubled("id bigint, twice bigint").compute(spark.range(0)).count() == 0
    assert apply_batches(spark.range(0), lambda b: b, "id bigint").count() == 0


def test_scoring_batches_are_bounded(spark):
    sizes = score_batches(
        spark.range(0, 1000, 1, 1), lambda: lambda b: pd.DataFrame({"n": [len(b)]}), "n bigint", rows=300
    )
    assert [n for (n,) in rows(sizes)] == [100, 300, 300, 300]


def test_table_step(spark):
    class Keep(TableStep):
        def transform(self, df):
            return df.where("id > 1")

    assert spark.range(3).transform(Keep().fit(spark.range(1)).transform).count() == 1
