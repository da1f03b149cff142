"""Every stage on what the one before kept, against brute force over the same rows."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_similarity import brute

from riskflow.llm import toxicity
from riskflow.session import materialise


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialise(stage(spark, docs[-1], folder), name))
    return docs


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    assert all(df.schema.names == stages[0].schema.names for df in stages[:5])


def test_toxic_documents_go(spark, folder, stages):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    gone = stages[0].join(stages[1], "doc_id", "left_anti")
    judged = gone.join(labels, "doc_id").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    assert judged.n and judged.toxic / judged.n > 0.8
    assert gone.count() < 0.3 * stages[0].count()
    model = toxicity.train(stages[0], labels)
    low = toxicity.score(stages[0], model, "text", "s").where(F.col("s") < toxicity.THRESHOLD)
    assert Counter(r.doc_id for r in low.collect()) == Counter(r.doc_id for r in stages[1].collect())


def test_copies_go(stages):
    def plain(text):
        return re.sub(r"[\x20\x09-\x0D]", "", text or "")

    best = {}
    for r in stages[1].collect():
        rank = (-len(r.text or ""), r.doc_id)
        best[plain(r.text)] = min(best.get(plain(r.text), rank), rank)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(d for _, d in best.values())


def test_near_copies_go(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({c for _, _, c in brute(rows)})


def test_mix_and_packing(stages):
    before = {r.doc_id: tuple(r) for r in stages[3].collect()}
    mixed = stages[4].collect()
    assert all(tuple(r) == before[r.doc_id] for r in mixed)
    first = Counter(r.doc_id for r in stages[5].where("start = 0").collect())
    assert first == Counter(r.doc_id for r in mixed)
    fill = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.where("n <> end OR n > 2048").isEmpty()


def test_run(spark, folder, stages):
    assert corpus_pipeline.run(spark, folder).count() == stages[5].count()
