"""Exact dedup, mixing and chat formatting: SQL, brute force and round trips."""

import hashlib
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import oracle
from riskflow.llm import chat, exact_dedup, mixing, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, folder, name):
    assert oracle.differences(queries.QUERIES[name](spark, folder), queries.ORACLES[name], oracle.connect(folder)) == []


def test_cuckoo_index_is_a_set():
    draw = random.Random(3)
    index, held = exact_dedup.CuckooIndex(1), {}
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    keys += [keys[0][:10] + bytes([i]) * 22 for i in range(40)]  # same fingerprint and buckets
    for step in range(20_000):
        key = draw.choice(keys)
        if draw.random() < 0.6:
            index.insert(key, step)
            held[key] = step
        else:
            assert index.delete(key) == (held.pop(key, None) is not None)
        probe = draw.choice(keys)
        assert index.get(probe) == held.get(probe) and (probe in index) == (probe in held)
    assert dict(index.items()) == held and len(index) == len(held) and index.buckets > 1


ROWS = [
    (1, "a b", "u"), (2, "ab", "u"), (3, " a\tb\n", "v"), (4, "  ab ", None), (5, None, None), (6, "", "w"), (None, " \n", "w"), (7, "a b", "w"), (7, "a b", "w"),
]


def test_exact_groups(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, row string")
    found = exact_dedup.exact_groups(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found) == sorted(
        [("1", "3", 4), ("2", "3", 4), ("3", "3", 4), ("4", "3", 4), ("5", "None", 3), ("6", "None", 3), ("None", "None", 3), ("7", "7", 2), ("7", "7", 2)]
    )
    assert Counter(r.doc_id for r in found if r.kept) == {3: 1, None: 1, 7: 1}
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == {ROWS[2]: 1, ROWS[6]: 1, ROWS[7]: 1}


def test_exact_groups_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.keep_first(none).count() == 0


def test_changes(spark):
    def table(*texts):
        return spark.createDataFrame([(exact_dedup.digest(t.encode()),) for t in texts], "digest binary")

    live = exact_dedup.apply_changes(table("a", "b", "c", "c"), table("d", "b"), table("b", "c", "x"))
    assert sorted(bytes(r.digest) for r in live.collect()) == sorted(exact_dedup.digest(t) for t in (b"a", b"b", b"d"))


def test_mixing_reaches_its_weights(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "if(id % 3 < 2, 'big', 'small') AS source", "'0123456789' AS text", "id AS rate")
    rates = mixing.source_rates(docs, {"big": 0.25, "small": 0.75}, epochs=2.0)
    assert {r.source: round(r.rate, 9) for r in rates.collect()} == {"big": 0.75, "small": 4.5}
    mixed = mixing.poisson_mix(docs, rates, copy="n")
    counts = Counter(r.source for r in mixed.collect())
    assert abs(counts["big"] - 4500) < 300 and abs(counts["small"] - 13500) < 500
    assert mixed.columns == [*docs.columns, "n"]
    first = [r.source for r in mixed.limit(400).collect()]
    assert 30 < first.count("big") < 250


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, None, None), (2, "e", ""), (3, "e", None), (4, "f", "text"), (4, "f", "text")], "doc_id bigint, source string, text string")
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    assert rates["e"] == 1.0 and set(rates) == {None, "e", "f"}
    counts = Counter(map(tuple, mixing.poisson_mix(docs, mixing.source_rates(docs)).collect()))
    assert counts[(4, "f", "text")] % 2 == 0
    none = docs.limit(0)
    assert mixing.poisson_mix(none, mixing.source_rates(none)).count() == 0
    assert mixing.poisson_mix(docs, mixing.source_rates(docs, {})).count() == 0


def test_mixing_without_keys(spark):
    """Rows without a key have draws of their own; SQL's draws are the same, null keys and texts included."""
    docs = spark.range(2000).selectExpr("cast(NULL AS bigint) AS doc_id", "'s' AS source", "concat('text ', id) AS text")
    mixed = Counter(r.text for r in mixing.poisson_mix(docs, mixing.source_rates(docs)).collect())
    assert 1800 < sum(mixed.values()) < 2200 and len(set(mixed.values())) > 3
    expected = {}
    for i in range(2000):
        u = int(hashlib.md5(f"{mixing.SEED}||{hashlib.md5(f'text {i}'.encode()).hexdigest()}".encode()).hexdigest()[:8], 16) / 2**32
        k, step, total = 0, math.exp(-1), math.exp(-1)
        while total <= u:
            k += 1
            step /= k
            total += step
        expected[f"text {i}"] = k
    assert mixed == {t: k for t, k in expected.items() if k}


def test_sums_of_a_high_rate(spark):
    rates = spark.createDataFrame([("a", 0.0), ("b", 2.5), (None, 50_000.0)], "source string, rate double")
    found = {r.source: r.sums for r in mixing.cumulative(rates).collect()}
    assert set(found) == {"b", None}
    assert all(s == sorted(s) and abs(s[-1] - 1) < 1e-9 for s in found.values())
    assert abs(found["b"][2] - math.exp(-2.5) * (1 + 2.5 + 2.5**2 / 2)) < 1e-12


TEXT = st.lists(st.sampled_from(["\\", ".", "n", "\n", "<|im_end|>", "<|im_start|>", "</s>", "[INST]", "[", "<", "<s>", "é", "|>", "x"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_chat_round_trip(turns):
    formatted, segments, _ = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert "".join(formatted[s["start"] : s["end"]] for s in segments) == formatted
    bodies = [formatted[s["start"] : s["end"]] for s in segments if s["role"] is not None]
    assert not any(mark in body for body in bodies for mark in chat.CHATML.marks())


def test_chat_machine():
    ok = [[("user", "a")], [("system", "s"), ("user", "a"), ("assistant", "b")]]
    bad = [[], [("assistant", "b")], [("user", "a"), ("user", "b")], [("system", "s")], [("user", "a"), ("system", "s")], [("tool", "x")]]
    assert all(chat.format_turns(t)[2] for t in ok) and not any(chat.format_turns(t)[2] for t in bad)
    with pytest.raises(ValueError):
        chat.Template(controls=("aba",))


def test_chat_query(spark, folder, tables):
    conversations = {}
    for r in sorted(tables("conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        conversations.setdefault(r.conv_id, []).append((r.role, r.text))
    conversations[-1] = [("user", queries.PROBE), ("assistant", queries.PROBE)]
    found = {r.conv_id: r for r in queries.op8_chat(spark, folder).collect()}
    assert set(found) == set(conversations)
    for key, turns in conversations.items():
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        r = found[key]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_odd_rows(spark):
    rows = [(None, 1, "user", None, 0), (2, None, None, "first", 0), (2, 0, "user", "second", 0), (2, 0, "user", "second", 0), (3, 1, "assistant", "x" * 200_000, 0)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")
    found = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    assert chat.read_turns(found[2].formatted) == [("", "first"), ("user", "second"), ("user", "second")]
    assert chat.read_turns(found[None].formatted) == [("user", "")] and found[None].valid
    assert len(found[3].formatted) > 200_000
    assert chat.format_conversations(table.limit(0)).count() == 0
