"""Manifest, prefix trie and decontamination against brute force, with odd rows."""

import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from riskflow.llm import decontamination, merkle, prefix_trie
from riskflow.llm.positions import numbered


def h(text):
    return sha256(text.encode()).hexdigest()


# -- positions -----------------------------------------------------------------------------------------
def test_positions_count_within_groups_of_any_size(spark):
    table = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") % 5).alias("v"))
    found = numbered(table, "g", [F.col("v")], "at", "total").toPandas()
    for _, part in found.groupby("g"):
        part = part.sort_values("at")
        assert part["at"].tolist() == list(range(len(part))) and (part["total"] == len(part)).all()
        assert part["v"].is_monotonic_increasing


# -- layout ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("height", range(8))
def test_layout_is_a_permutation_of_whole_subtrees(height):
    places = [merkle.address(height, d, np.arange(1 << d)) for d in range(height + 1)]
    assert sorted(np.concatenate(places).tolist()) == list(range((2 << height) - 1))
    upper = (height + 1) // 2  # levels of the upper tree
    assert sorted(np.concatenate(places[: max(upper, 1)]).tolist()) == list(range((1 << max(upper, 1)) - 1))
    if height:
        for i in range(1 << upper):  # each lower tree lies in one run
            own = np.concatenate([merkle.address(height, d, np.arange(i << (d - upper), (i + 1) << (d - upper))) for d in range(upper, height + 1)])
            assert own.max() - own.min() + 1 == len(own)


def tree(leaves):
    """Root, and for each leaf the steps up: (side, digest)."""
    steps, held, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        above, owners = [], []
        for i in range(0, len(level), 2):
            run = level[i : i + 2]
            for side, own in zip((1, 2), held[i : i + 2]):
                for leaf in own:
                    steps[leaf].append((side, run[2 - side] if side == 2 else run[1]) if len(run) == 2 else (0, ""))
            above.append(h("".join(run)))
            owners.append(sum(held[i : i + 2], []))
        level, held = above, owners
    return level[0], steps


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


DOCS = [
    *((i, f"text {i} é", ("en", "de", None, "ß")[min(i % 5, 3)], i % 9) for i in range(40)),
    (7, "text 7 é", "de", 7), (None, "no key", "en", 1), (100, None, None, None), (101, "", "en", 0), (102, "long " * 20000, "fr", 3),
    (103, "same key", "ß", 1), (103, "same key, other text", "ß", 2),
]
DOC_SCHEMA = "doc_id long, text string, lang string, n_chars long"


@pytest.mark.parametrize("height", [2, 10])
def test_manifest_equals_brute_force(spark, height):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA).select("*", F.lit(1).alias("leaf"), F.lit("x").alias("tree"), F.lit(2).alias("at"))
    changed = {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    manifest = merkle.build_manifest(docs, ["doc_id", "n_chars", "text"], claims=changed, height=height)
    groups = defaultdict(list)
    for key, text, lang, n in DOCS:
        leaf = h(field(key) + field(n) + field(text))
        claim = h(field(key) + field(n + 1) + field(text)) if key is not None and key % 3 == 0 and n is not None else leaf
        groups[lang].append((key is not None, key or 0, leaf, key, claim))
    trees = [(lang, sorted(groups[lang])) for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode()))]
    built = [tree([r[2] for r in found]) for _, found in trees]
    root, over = tree([b[0] for b in built])
    expected = []
    for (_, found), (subroot, steps), above in zip(trees, built, over):
        for (_, _, leaf, key, claim), own in zip(found, steps):
            way = own + above
            expected.append((key, leaf, subroot, root, h("".join(s for _, s in way)), merkle.fold(claim, way), merkle.fold(claim, way) == root))
    got = rows(manifest.proofs())
    assert got == sorted(expected, key=lambda r: tuple((v is not None, v) for v in r))
    assert rows(merkle.Manifest.open(spark, manifest.path).proofs()) == got
    assert manifest.root == root


def test_manifest_of_no_rows_and_of_one(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    manifest = merkle.build_manifest(empty, ["doc_id"])
    assert manifest.root is None and manifest.proofs().count() == 0
    one = merkle.build_manifest(spark.createDataFrame([(5, "x", None, 1)], DOC_SCHEMA), ["doc_id"])
    (row,) = one.proofs().collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == h("1:5") and row.proof_sha256 == h("") and row.verified


# -- trie ---------------------------------------------------------------------------------------------
def conversation_rows():
    made = []
    for c in range(60):
        first = "hello" if c % 3 else f"start {c % 5}"
        turns = [("user", first), ("assistant", f"answer {c % 4}"), ("user", "  and   more words "), ("assistant", f"end {c % 2}")]
        made += [(c, t, role, text) for t, (role, text) in enumerate(turns[: c % 5])]
    made += [(70, None, "user", "before all"), (70, 0, None, "hello"), (70, 1, "user", None), (70, 1, "user", None)]
    made += [(71, 0, "user", "hello"), (71, 1, "b", "tie"), (71, 1, "a", "tie"), (None, 0, "user", "lost"), (72, 0, "user", "word " * 5000)]
    made += [(1000 + i, t, "user", f"copy {t}") for i in range(30) for t in range(6)]
    made += [(2000 + i, t, "user", f"deep {t}") for i in range(9) for t in range(i)]
    return made


def expected_nodes(sequences):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(members[path]) - 1) * own
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p],
            h(",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(p))))),
        )
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("limit", [prefix_trie.CONTAINER, 25])
@pytest.mark.parametrize("rebuild", [False, True])
def test_trie_equals_brute_force(spark, limit, rebuild):
    made = conversation_rows()
    table = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("ids"), F.lit(2).alias("conv"))
    found = prefix_trie.sequences(table)
    said = defaultdict(list)
    for c, t, role, text in made:
        if c is not None:
            said[c].append(((t is not None, t or 0), role or "", text or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v)] for c, v in said.items()}
    if rebuild:
        from zlib import crc32

        found = prefix_trie.with_shared_start(found)
        start = {c: crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - c % 20, [])[: start[c]] + v[start[c] :] for c, v in turns.items()}
    got = prefix_trie.trie_nodes(found, limit).fillna({"parent_conv_id": -1})
    assert rows(got, *COLUMNS) == expected_nodes(turns)


def test_trie_of_nothing_and_of_empty_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie_nodes(prefix_trie.sequences(empty)).count() == 0
    bare = spark.createDataFrame([(4, []), (3, [])], "conv long, turns array<struct<id:binary,words:int>>")
    assert rows(prefix_trie.trie_nodes(bare), *COLUMNS) == [(3, 0, None, 2, 0, 1, 0, h("3,4"))]


def test_list_digest_of_a_large_group_is_read_in_pieces(spark):
    table = spark.range(40000).select(F.lit(b"hot").alias("g"), "id")
    (row,) = prefix_trie.listed_digests(table, "g", "id").collect()
    assert (row["smallest"], row["count"], row["digest"]) == (0, 40000, h(",".join(map(str, range(40000)))))


# -- decontamination ------------------------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_force(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    found = []
    for key, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    named |= windows[tuple(w[i : i + n])]
        found.append((key, len(w), len(hit), ",".join(sorted(named))))
    return sorted(found, key=lambda r: tuple((v is not None, v) for v in r))


def passages():
    rng = np.random.default_rng(3)
    common = [f"w{i}" for i in range(6)]  # few words, so that k-grams repeat
    vocabulary = [f"Wort{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, 25))) for i in range(8)]
    items += [(8, items[0][1].upper()), (9, " ".join(rng.choice(common, 14))), (10, "a " * 30), (11, ""), (12, None), (5, "twice the same id " * 3)]
    docs = []
    for i in range(40):
        w = list(rng.choice(vocabulary, 60))
        at, n = rng.integers(0, 40), 8 + i % 5  # spans of 8 to 12 words: from 10 on they are hits
        source = items[i % 8][1].split()
        w[at : at + n] = source[3 : 3 + n]
        docs.append((i, ", ".join(w)))
    docs += [(50 + i, " ".join(rng.choice(common, 40))) for i in range(10)]
    docs += [(70, None), (71, ""), (72, "a " * 12), (73, "a " * 9), (74, items[2][1]), (74, items[2][1]), (None, items[3][1] + "!"), (75, "x " * 30000 + items[1][1])]
    return docs, items


@pytest.mark.parametrize("short", [[], [(20, "Wort7"), (None, "wort1 WORT2"), (21, "w0 w1 w2 w3 w4 w5 w0"), (22, "é")]])
def test_decontamination_equals_brute_force(spark, short):
    docs, items = passages()
    items = items + short
    table = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("tie"), F.lit(2).alias("words"), F.lit(3).alias("id"))
    found = decontamination.contamination(table, spark.createDataFrame(items, "item_id long, text string"))
    got = rows(found.select("doc_id", "n_words", "n_hit", F.array_join("items", ",")))
    assert got == brute_force(docs, items)


def test_every_shared_window_shares_a_kept_hash(spark):
    docs, items = passages()
    table = spark.createDataFrame([(i, " ".join(words(t))) for i, t in [*docs, *items] if t], "id long, text string").select(
        decontamination.words_of(F.col("text")).alias("words"), F.transform(decontamination.winnowed(decontamination._hashes(decontamination.words_of(F.col("text")))), lambda m: m["at"]).alias("kept")
    )
    for row in table.collect():
        kept = set(row.kept)
        for i in range(len(row.words) - 9):
            assert kept & set(range(i, i + 6))


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontamination.contamination(docs, none), "doc_id", "n_words", "n_hit") == [(1, 2, 0)]
    assert decontamination.contamination(docs.limit(0), none).count() == 0
