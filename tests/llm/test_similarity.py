"""N-gram Jaccard join and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow import session
from riskflow.llm import components, fingerprints, ngram_join, queries
from riskflow.llm.common import run_hashes

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """(key, size, component) of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return Counter((key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows))


def _edited(draw, words):
    words = list(words)
    for _ in range(draw.randint(0, 3)):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    made = []
    for group in range(60):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randint(3, 120))]
        if group % 3 == 0:
            base = base + passage
        for _ in range(draw.randint(1, 7)):
            made.append(" ".join(_edited(draw, base)).replace("w1", "W1" if draw.random() < 0.5 else "w1"))
    made += [None, "", " \n", "one", "One", "one two three four", "a b c d e", "x " * 30_000, "a b c d e f"]
    made += [made[0], made[0]]
    keys = list(range(len(made)))
    draw.shuffle(keys)
    keys[3], keys[-1] = None, keys[-2]
    return list(zip(keys, made))


def test_components_of_documents(spark, rows):
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id bigint, text string, node int").repartition(3)
    found = ngram_join.jaccard_components(docs)
    assert Counter(map(tuple, found.collect())) == brute(rows)


def test_tiles_alone_find_all(spark, rows, monkeypatch):
    """Small tiles, bitmaps and rank classes don't lose links."""
    monkeypatch.setattr(ngram_join, "TILE", 3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, ngram_join.jaccard_components(docs).collect())) == brute(rows)


def _meeting_through_a_third(tag):
    """A short text, two near copies that hold it and a common passage, and ten pages with that passage."""
    short, common = [f"{tag}p{i}" for i in range(30)], [f"q{i}" for i in range(30)]
    both = short + common
    texts = [short, both, [*both[:45], "changed", *both[46:]]]
    texts += [[f"page{n}w{i}" for i in range(200)] + common for n in range(10)]
    return [" ".join(words) for words in texts]


def test_pair_hidden_by_a_third_document(spark):
    """Where the two copies meet, the smallest node mostly is the short text, which links with neither."""
    for tag in range(100):
        texts = _meeting_through_a_third(f"t{tag}")
        data, offsets = "".join(texts[:3]).encode(), np.cumsum([0, *(len(t) for t in texts[:3])])
        short, *copies = ngram_join._node(*ngram_join.shingle_sets(np.frombuffer(data, np.uint8), offsets)).tolist()
        if short < min(copies):
            rows = list(enumerate(texts))
            docs = spark.createDataFrame(rows, "doc_id bigint, text string")
            found = Counter(map(tuple, ngram_join.jaccard_components(docs).collect()))
            assert found == brute(rows)
            assert {key: root for key, _, root in found}[2] == 1
            return
    raise AssertionError("no order of nodes as wanted")


def test_no_two_documents_meet(spark):
    rows = [(1, "a b c d e"), (2, "f g h i j"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, ngram_join.jaccard_components(docs).collect())) == brute(rows)


def test_jaccard_query(spark, folder, tables):
    rows = [(r.doc_id, r.text) for r in tables("documents").collect()]
    assert Counter(map(tuple, queries.op7_jaccard(spark, folder).collect())) == brute(rows)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(4, text, "a", 1), (2, text + " end", "b", 1), (2, text + " end", "b", 1), (7, "", "c", 1), (7, None, None, 1), (None, text + " last", "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, row int")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == {rows[1]: 1, rows[3]: 1, rows[4]: 1}
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_bound_is_an_upper_bound():
    draw = np.random.default_rng(0)
    for _ in range(200):
        a = draw.choice(2**62, draw.integers(1, 9000)).astype(np.uint64)
        b = np.concatenate([draw.choice(a, draw.integers(0, len(a) + 1), replace=False), draw.choice(2**62, draw.integers(1, 300)).astype(np.uint64)])
        both = [np.unique(x) for x in (a, b)]
        bits = ngram_join._Bitmaps([ngram_join._bitmaps(x, np.array([0, len(x)]))[0] for x in both])
        apart = len(np.setxor1d(*both))
        assert bits.differing(np.array([0]), np.array([1]))[0] <= apart


@pytest.mark.parametrize("size", [100, 1_000, 5_000, 20_000])
def test_bound_tells_disjoint_sets_apart(size):
    draw = np.random.default_rng(size)
    a, b = (np.unique(draw.integers(0, 2**63, size).astype(np.uint64)) for _ in range(2))
    bits = ngram_join._Bitmaps([ngram_join._bitmaps(x, np.array([0, len(x)]))[0] for x in (a, b)])
    overlap = (2 * size - bits.differing(np.array([0]), np.array([1]))[0]) // 2
    assert not ngram_join._enough(overlap, size, size)


def test_blocks_of_frequent_keys(spark, rows, monkeypatch):
    """Keys dealt out by pairs of blocks, with hardly any pairs given directly and short memories, lose no links."""
    for name, value in (("BLOCK", 2), ("SMALL", 2), ("TILE", 3), ("EARLIER", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, ngram_join.jaccard_components(docs).collect())) == brute(rows)


def test_words_that_clash_in_polynomial_hashes(spark):
    signs = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    swapped = signs.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{signs} one two three four"), (2, f"{swapped} one two three four")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, ngram_join.jaccard_components(docs).collect())) == brute(rows)


def test_run_hashes_follow_the_bytes_alone():
    texts = [b"", b"a", b"A", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", b"x" * 100, b"x" * 101, b"a"]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = run_hashes(data, ends - [len(t) for t in texts], ends)
    assert len(set(found.tolist())) == len(set(texts)) and found[1] == found[-1]
    lower = run_hashes(data, ends - [len(t) for t in texts], ends, lower=True)
    assert lower[1] == lower[2]


def test_texts_are_not_shuffled_to_be_chosen(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") % 1000 != 0, F.col("id")).alias("id"), F.lit(b"some text").alias("text"))
    wanted = docs.where("id IS NULL OR id % 9 = 0").select("id").repartition(5)
    chosen = ngram_join._perhaps(docs, wanted)
    assert chosen.columns == ["id", "text", "bucket", "bits"]
    assert "SortMergeJoin" not in chosen._jdf.queryExecution().toString() and "BroadcastHashJoin" in chosen._jdf.queryExecution().toString()
    found = [r["id"] for r in chosen.select("id").collect()]
    needed = [i for i in range(20_000) if i % 1000 and i % 9 == 0]
    assert set(needed) <= set(found) and found.count(None) == 20 and len(found) <= len(needed) + 20 + 40


def test_arrays_go_when_pairs_are_verified(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_root", lambda spark: str(tmp_path))
    ngram_join.jaccard_nodes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert list(tmp_path.glob("**/links-*")) and not list(tmp_path.glob("**/shingles-*"))


def test_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialise", lambda df, label: written.append(label) or session.materialise(df, label))
    stars = spark.createDataFrame([(5, 1), (6, 1), (1, 7), (9, 8), (4, 4)], "a long, b long")
    found = sorted(map(tuple, components.components(stars).collect()))
    assert found == [(1, 1), (5, 1), (6, 1), (7, 1), (8, 8), (9, 8)] and len(written) == 1


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {n: n for pair in links for n in pair}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {n: r for n, r in root.items() if n in found}
    assert all(n in found for a, b in links if a != b for n in (a, b))


def _pairs(rows):
    return {key: text or "" for key, text in rows}


@pytest.mark.parametrize("parts", ["1", "7", "300"])
def test_edited_text_and_next(spark, tables, parts):
    rows = [(r.doc_id * 3 % 1009, r.text) for r in tables("documents").collect()] + [(5000, ""), (5001, None), (5002, "é日x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").dropDuplicates(["doc_id"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = fingerprints.fingerprint_pairs(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    texts = _pairs((r.doc_id, r.text) for r in docs.collect())
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    marks = {r.doc_id: r.fingerprint for r in found}
    for r in found:
        text, half = texts[r.doc_id], len(texts[r.doc_id]) // 2
        edited = text[: len(text) - half] + texts[following[r.doc_id]][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
        assert (r.near_next == 1) >= (r.fingerprint == marks[following[r.doc_id]])
    assert sum(r.near_edited > r.near_next for r in found) > 0.8 * len(found)


def test_equal_texts_and_odd_rows(spark):
    rows = [(1, "some words here", 1), (2, "some words here", 2), (2, "some words here", 2), (None, None, 3), (None, "x", 3), (9, "long " * 60_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, terms int")
    found = fingerprints.fingerprint_pairs(docs).collect()
    assert len(found) == len(rows)
    assert len({r.fingerprint for r in found if r.doc_id in (1, 2)}) == 1
    one = fingerprints.fingerprint_pairs(docs.limit(1)).collect()[0]
    assert one.near_next == 1.0
    assert fingerprints.fingerprint_pairs(docs.limit(0)).count() == 0
