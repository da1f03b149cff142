"""Token files, packing and token counts against the tokenizers and brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskflow.llm import packing, queries, token_counts, tokens
from riskflow.session import scratch_path

ODD = [
    "", "plain words, here.", "It's O'Neil's; we'll they've I'd\tnot\r\nsee\x0bthis\x0cend", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "ÀÉ ßtraße İstanbul ǅ ﬁne é áb .. ... ,. x., y.. Ünï.", "日本語 テスト　 \u0085x 12 3.5 a1b2", "\x1c\x1d a\x1eb", "ªº µm ÿ Ώ Σίσυφος ΣΑΣ",
    "   ", "word " * 5000,
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(tokens.tokenizer_path())


def test_word_encoder_equals_the_tokenizer(reference, tables):
    texts = [*ODD, *(r.text for r in tables("documents").select("text").collect())]
    encode = tokens.WordEncoder(tokens.tokenizer_path())
    for text in texts:
        expected = [*reference.encode(text, add_special_tokens=False).ids, 1]
        assert np.frombuffer(encode.encode(text), encode.dtype).tolist() == expected


def test_word_encoder_starts_anew(monkeypatch, reference):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    encode = tokens.WordEncoder(tokens.tokenizer_path())
    for text in ("a b c d e", "f g h", "a"):
        assert np.frombuffer(encode.encode(text), encode.dtype).tolist()[:-1] == reference.encode(text, add_special_tokens=False).ids


def _documents(spark):
    rows = [(i * 7 % 10, t, "x") for i, t in enumerate(ODD)] + [(None, "null key", "x"), (3, None, None), (3, "", "y"), (4, "again", "z"), (4, "again", "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, start string")


def test_files_hold_all_ids_in_order(spark, reference):
    path = scratch_path(spark, "tokens")
    docs = _documents(spark)
    shards = tokens.write_tokens(docs, path, tokens.tokenizer_path())
    found = tokens.read_tokens(spark, path).orderBy("start").collect()
    expected = sorted(((r.doc_id is not None, r.doc_id, r.text is not None, r.text or "") for r in docs.collect()))
    assert [r.doc_id for r in found] == [e[1] for e in expected]
    at = 0
    for r, e in zip(found, expected):
        ids = [*reference.encode(e[3], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        at += len(ids)
    assert tokens.read_manifest(path) == shards


def test_query_crc(spark, folder, reference, tables):
    texts = {r.doc_id: r.text for r in tables("documents").collect()}
    for r in queries.op2_token_files(spark, folder).collect():
        ids = [*reference.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    path = scratch_path(spark, "tokens")
    assert tokens.write_tokens(none, path, tokens.tokenizer_path()) == []
    assert tokens.read_tokens(spark, path).count() == 0
    assert packing.pack_documents(none, tokens.tokenizer_path()).count() == 0
    assert token_counts.token_counts(none, tokens.tokenizer_path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("window", [1, 2, 16, 64])
def test_plan_takes_each_piece_once(window):
    draw = random.Random(window)
    for _ in range(20):
        histogram = dict(Counter(draw.randint(1, window) for _ in range(draw.randint(0, 400))))
        used = Counter()
        for pattern, times in packing.plan(histogram, window):
            assert sum(pattern) <= window and times > 0
            used.update({n: m * times for n, m in Counter(pattern).items()})
        assert used == Counter(histogram)


def test_least_squares_is_a_minimum():
    histogram = {n: 10 * n for n in range(1, 32)}
    patterns = packing.combinations(histogram, 32)
    x = np.array(packing.least_squares(patterns, histogram, sweeps=3000))
    matrix = np.zeros((33, len(patterns)))
    for i, p in enumerate(patterns):
        for n in p:
            matrix[n, i] += 1
    slope = matrix.T @ (matrix @ x - np.array([histogram.get(n, 0) for n in range(33)]))
    assert slope.min() > -2 and np.abs(slope[x > 1e-6]).max() < 2


def _check_packing(placed, texts, reference, window=2048):
    sequences, documents = {}, {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    for key, text in texts.items():
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        found = sorted(documents[key], key=lambda r: r.start)
        assert [i for r in found for i in np.frombuffer(bytes(r.ids), "<u4")] == ids
        assert {r.doc_tokens for r in found} == {len(ids)}
    return sum(r.length for r in placed) / (window * len(sequences))


def test_packing(spark, reference, tables):
    docs = tables("documents")
    placed = packing.pack_documents(docs.repartition(3), tokens.tokenizer_path()).collect()
    assert _check_packing(placed, {r.doc_id: r.text for r in docs.collect()}, reference) > 0.85


def test_packing_odd_rows(spark):
    docs = _documents(spark)
    placed = packing.pack_documents(docs, tokens.tokenizer_path()).collect()
    assert sum(r.doc_id is None for r in placed) == 1
    assert sum(r.doc_id == 4 and r.doc_tokens == 2 for r in placed) == 2
    assert max(r.offset + r.length for r in placed) <= 2048


def _greedy(word, vocabulary):
    count, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return -1
        count, at = count + 1, end
    return count


def test_automaton_equals_greedy_search():
    draw = random.Random(5)
    for _ in range(60):
        vocabulary = {"_" * draw.randint(0, 1) + "".join(draw.choices("ab", k=draw.randint(0, 5))) for _ in range(draw.randint(1, 14))} - {""}
        match = token_counts.LongestMatch(vocabulary, "_")
        for _ in range(60):
            word = "".join(draw.choices("abc" if draw.random() < 0.2 else "ab", k=draw.randint(0, 12)))
            assert match[word] == _greedy("_" + word, vocabulary)


def test_token_counts_of_documents(spark, tables):
    path = tokens.tokenizer_path("piece_bpe_32k.model")
    vocabulary = set(token_counts.piece_vocabulary(path))
    docs = tables("documents").limit(40).unionByName(_documents(spark).select("doc_id", "text"), allowMissingColumns=True)
    texts = Counter()
    for r in docs.collect():
        counts = [_greedy("▁" + w, vocabulary) for w in (r.text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        texts[(r.doc_id, len(counts), sum(max(c, 1) for c in counts), counts.count(-1))] += 1
    assert Counter(map(tuple, token_counts.token_counts(docs, path).collect())) == texts


def test_writing_gives_back_what_earlier_tasks_left(spark, tmp_path):
    """A worker kept its tables of powers from stage to stage; in the pipeline they came on top of the tokenizer."""
    from riskflow.llm import common

    common._powers(1 << 10)
    common.give_back()
    assert common._powers.cache_info().currsize == 0

    def powers(batches, size=0):
        for batch in batches:
            if size:
                common._powers(size)
            yield pa.RecordBatch.from_pydict({"n": [common._powers.cache_info().currsize]})

    one = spark.range(1).coalesce(1)
    assert one.mapInArrow(lambda b: powers(b, 1 << 10), "n long").first().n > 0
    tokens.write_tokens(one.select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")), str(tmp_path / "t"), tokens.tokenizer_path(), ordered=False)
    assert one.mapInArrow(powers, "n long").first().n == 0
