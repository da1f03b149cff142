"""Suffix arrays against sorting, and removal of repeats against counting all windows."""

import hashlib
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from riskflow.llm import queries, repeats
from riskflow.llm.suffix_array import suffix_array


def test_suffix_array_sorts():
    draw = random.Random(1)
    for i in range(1500):
        letters = draw.choice([1, 2, 3, 5, 200])
        text = [draw.randrange(letters) for _ in range(draw.randrange(0, 40))]
        if i % 5 == 0:
            text = (text[:5] or [1]) * 8
        assert suffix_array(text) == sorted(range(len(text)), key=lambda j: text[j:])


def brute(rows, length):
    seen = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    found = Counter()
    for (key, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        found[(key, len(raw), sum(gone), spans, kept)] += 1
    return found


def result(df):
    return Counter((r[0], r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in df.collect())


def _rows(seed, length, letters):
    draw = random.Random(seed)

    def text(n):
        return "".join(draw.choice(letters) for _ in range(n))

    passages = [text(draw.randint(length // 2, 3 * length)) for _ in range(5)]
    made = []
    for _ in range(60):
        parts = [draw.choice([text(draw.randint(0, 2 * length)), draw.choice(passages), draw.choice(passages)[: draw.randint(1, 2 * length)]]) for _ in range(draw.randint(1, 4))]
        made.append("".join(parts))
    made += [made[0], made[1] + "x", "x" + made[1], None, "", "a" * 5 * length, "é" * length]
    keys = list(range(len(made)))
    keys[2] = keys[4] = None
    rows = list(zip(keys, made))
    return [*rows, rows[7]]


@pytest.mark.parametrize(("seed", "length", "gram", "group", "letters"), [(1, 24, 10, 512, "ab"), (2, 24, 10, 1, "abcdefgh\n"), (3, 40, 39, 2, "abc"), (4, 16, 1, 3, "ab é"), (5, 400, 200, 3, "abcdefghijkl ")])
def test_removal(spark, monkeypatch, seed, length, gram, group, letters):
    monkeypatch.setattr(repeats, "GROUP", group)
    if length < 400:
        monkeypatch.setattr(repeats, "BLOCKS", (8, 3, 1))
    rows = _rows(seed, length, letters)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, spans string").repartition(3)
    assert result(repeats.remove_repeats(docs, length=length, gram=gram)) == brute(rows, length)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.remove_repeats(none).count() == 0


def test_query(spark, folder, tables):
    rows = [(r.doc_id, r.text) for r in tables("documents").collect()]
    expected = {k: (n, g, s, hashlib.sha256(kept).hexdigest()) for k, n, g, s, kept in brute(rows, 400)}
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op3_repeats(spark, folder).collect()}
    assert found == expected


class Task:
    """Takes the function that a query gives to its tasks, to call it here."""

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_memory_of_a_task():
    draw = random.Random(6)
    texts = ["".join(draw.choices("abcdefghijkl ", k=20_000)).encode() for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(200)), "tie": [0] * 200, "text": texts})
    task = repeats._segment_rows(Task(), 400, 200)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in task.run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 200
    assert peak < 48 << 20


def test_one_python_process_a_core(spark, monkeypatch):
    """Segments are cut and split in one pass; workers of two would stay in memory side by side."""
    plans = []

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")))
        return kept(df, label)

    kept = repeats.materialise
    monkeypatch.setattr(repeats, "materialise", seen)
    docs = spark.createDataFrame(_rows(7, 400, "abcdefghijkl "), "doc_id bigint, text string")
    assert repeats.remove_repeats(docs).count() == docs.count()
    assert dict(plans)["blocks"] == 1


def test_narrow_length(spark):
    """Windows shorter than the widest block have no core there; those blocks are left out."""
    rows = _rows(8, 24, "ab")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(repeats.remove_repeats(docs, length=24, gram=10)) == brute(rows, 24)


def test_edges_by_bytes_of_cores():
    """Blocks whose cores only share a hash are not compared; equal windows of others are found, at the places that they have."""
    draw = random.Random(9)
    width, length = 8, 24
    core, other = (bytes(draw.choices(b"abc", k=length - width + 1)) for _ in range(2))
    rows = []
    for k in range(40):
        left, right = (bytes(draw.choices(b"ab", k=width - 1)) for _ in range(2))
        rows.append((k // 20, k, width - 1, left + (other if k % 5 == 0 else core) + right))
    columns = dict(zip(("core", "block", "at", "text"), map(list, zip(*rows)), strict=True))
    batch = pa.RecordBatch.from_pydict(columns)
    found = set()
    for b in repeats._edges(iter([batch.slice(0, 27), batch.slice(27)]), width, length):
        for r in b.to_pylist():
            found |= {(r["core"], r["block"], s) for s in range(r["first"], r["last"] + 1)}
    seen = Counter((c, s, t[s : s + length]) for c, _, _, t in rows for s in range(width))
    assert found == {(c, k, s) for c, k, _, t in rows for s in range(width) if seen[c, s, t[s : s + length]] > 1}


def test_equal_rows_hold_their_spans_once(spark):
    draw = random.Random(10)
    text = "".join(draw.choices("abcdefghijkl ", k=1500))

    def spans(n):
        rows = [(1, 1, text.encode())] * n + [(2, 2, (text[:700] + "-" + text[701:]).encode())]
        found = repeats.covered(spark.createDataFrame(rows, "id bigint, tie bigint, text binary")).collect()
        return {r["id"]: (len(r.spans), repeats.merged((s.start, s.end) for s in r.spans)) for r in found}

    assert spans(60) == spans(2)
    assert spans(60)[1][1] == [(0, 1500)]
