import pytest
from pyspark.sql import functions as F

from conftest import rows
from riskflow import session


def test_scratch_paths_are_new_and_in_the_shared_folder(spark):
    root = session.checkpoint_root(spark)
    a, b = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert a != b and a.startswith(root)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or root == configured


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_materialised_rows_do_not_change(spark):
    df = spark.sql("SELECT id, rand() AS r, CAST(NULL AS STRING) AS s FROM range(50)")
    kept = session.materialise(df)
    assert rows(kept) == rows(kept) and kept.dtypes == df.dtypes


def test_spread_follows_from_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_ROWS", 100)

    def layout(parts):
        dealt = session.spread(spark.range(1000).select("id", (F.col("id") % 7).alias("v")).repartition(parts))
        return rows(dealt.select(F.spark_partition_id(), "id")), dealt.inputFiles()

    few, files = layout(3)
    many, _ = layout(40)
    assert sorted(r[1] for r in few) == list(range(1000)) and len(files) == 10

    def together(found):
        parts = {}
        for part, i in found:
            parts.setdefault(part, set()).add(i)
        return sorted(map(sorted, parts.values()))

    assert together(few) == together(many)


def test_scope_deletes_what_it_wrote(spark):
    import os

    root = session.checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with session.scratch_scope(spark) as scope:
        kept = session.materialise(spark.range(5))
        with session.scratch_scope(spark) as inner:
            session.materialise(spark.range(3))
        assert kept.count() == 5 and inner.startswith(f"{scope}/") and not os.path.exists(f"{root}/{inner}")
    assert set(os.listdir(root)) == before
    outside = session.scratch_path(spark, "x")
    assert "scope-" not in outside


def test_a_search_leaves_no_tables_of_its_trials(spark):
    import os

    from riskflow.operators.models import BoostedTreesClassifier
    from riskflow.operators.tuning import RandomSearch

    cases = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    root = session.checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(root))

    def train(part, params):
        return BoostedTreesClassifier((), ["x"], "y", maxIter=1, maxDepth=params["depth"]).fit(part)

    search = RandomSearch(trials=2, folds=2, parallelism=2, concurrent=2)
    best, value = search.optimize_model(cases, "y", "id", train, lambda model, part: model.evaluate(part, "accuracy"), {"depth": lambda rng: rng.randint(1, 2)})
    assert value == 1.0 and [t.state for t in search.results] == ["complete"] * 2
    left = set(os.listdir(root)) - before
    assert all(name.startswith(("folds-", "spread-")) for name in left if not os.path.isdir(f"{root}/{name}/rdd-0")), left


def test_a_local_cluster_needs_the_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return None

    class Context:
        master = "local-cluster[2,1,1024]"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())
