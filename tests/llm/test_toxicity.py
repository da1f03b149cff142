"""The classifier: held-out quality, texts without words, one label only, features across slices."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import queries, toxicity
from riskflow.llm.common import bytes_of, slices

CLEAN = "the river runs to sea and back again with every tide of spring".split()
BAD = ["vermin", "verminous", "verminlike"]


def _rows(n, seed=0):
    draw = np.random.default_rng(seed)
    for i in range(n):
        words = list(draw.choice(CLEAN, draw.integers(5, 60)))
        toxic = int(draw.random() < 0.3)
        for _ in range(toxic * draw.integers(1, 4)):
            words.insert(int(draw.integers(0, len(words))), BAD[int(draw.integers(0, 2))])
        yield i, " ".join(words), "en" if i % 2 else "fr", toxic


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame(list(_rows(1500)), "doc_id bigint, text string, lang string, toxic int")
    return toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))


def test_unseen_rows_and_endings(spark, trained):
    rows = [*_rows(400, seed=1), (9001, "the tide is verminlike and", None, 1), (9002, "VERMIN.", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int")
    found = toxicity.score(docs, trained, "text", "score").collect()
    right = [(r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in found]
    assert np.mean(right) > 0.98 and all(0 <= r.score <= 1 for r in found)
    assert found[0].asDict().keys() == {"doc_id", "text", "lang", "toxic", "score"}


def test_odd_texts(spark, trained):
    rows = [(None, None), (1, ""), (1, " \n "), (2, "x"), (3, "tide " * 300_000), (4, "日本語 \x00 ünï")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, trained, "text", "score").collect()}
    assert len({found[(None, None)], found[(1, "")], found[(1, " \n ")]}) == 1
    assert found[(None, None)] < toxicity.THRESHOLD and found[(3, rows[4][1])] < toxicity.THRESHOLD
    assert toxicity.score(docs.limit(0), trained, "text", "score").count() == 0


def test_one_label_only(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    assert toxicity.train(docs, labels).scores(*_bytes(["a", ""])).tolist() == [0.0, 0.0]
    assert toxicity.train(docs, labels.limit(0)).share == 0.0


def _bytes(texts):
    import pyarrow as pa

    return bytes_of(pa.array([t.encode() for t in texts], pa.binary()))


def test_scores_do_not_depend_on_neighbours(trained):
    import pyarrow as pa

    texts = [t for _, t, _, _ in _rows(50, seed=2)] + ["", "word"]
    whole = trained.scores(*_bytes(texts))
    alone = np.concatenate([trained.scores(*_bytes([t])) for t in texts])
    assert np.allclose(whole, alone, atol=1e-5)
    batch = pa.RecordBatch.from_pydict({"t": pa.array([t.encode() for t in texts] + [None], pa.binary())})
    assert sum(b.num_rows for b in slices([batch, batch.slice(3, 0)], "t", 100)) == len(texts) + 1


def test_query(spark, folder):
    found = queries.op1_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(r.predicted == int(r.score >= 0.7) for r in found)


def test_long_texts_go_in_stretches(trained, monkeypatch):
    words = np.random.default_rng(4).choice([*CLEAN, *BAD], 4000)
    raw = _bytes(["", " ".join(words), "tide", "", " ".join(words[:130]), "vermin"])
    rows, first = toxicity.features(*raw)
    network = toxicity.Network()
    whole, guessed = network._pooled(rows, first, places=True), trained.language(rows, first)
    monkeypatch.setattr(toxicity, "STRETCH", 128)
    parts = network._pooled(rows, first, places=True)
    assert np.allclose(whole[0], parts[0], atol=1e-6) and (whole[3] == parts[3]).mean() > 0.98
    assert (trained.language(rows, first) == guessed).all()


def test_repeated_keys_and_clashing_names(spark, trained):
    docs = spark.createDataFrame([(1, "tide", "en", "x"), (1, "sea", None, "y"), (1, "sea", None, "y")], "doc_id bigint, text string, lang string, Score string")
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id bigint, toxic int")
    rows = toxicity.training_rows(docs, labels, "toxic", "doc_id", "text", "lang", 10)
    assert [(r["key"], r["label"], len(r["words"])) for r in rows] == [(1, 1, 8)]
    found = toxicity.score(docs, trained, "text", "score")
    assert found.columns == ["doc_id", "text", "lang", "score"] and len({r.score for r in found.where("text = 'sea'").collect()}) == 1
    own = toxicity.score(docs, trained, "text", "text")
    assert own.columns == ["doc_id", "lang", "Score", "text"] and own.schema["text"].dataType.simpleString() == "double"
    assert [r.h for r in spark.range(1).select(F.lit(None).cast("bigint").alias("k")).select(toxicity.held_out("k").alias("h")).collect()] == [False]
