"""Pack documents into sequences of one window by non-negative least squares.

Documents longer than the window give whole windows and a rest. The rests' lengths are a histogram of at most
one bin per length. Shallow combinations of lengths that fill a window (pairs and triples) are the columns of
a matrix; how often to repeat each is the non-negative least-squares solution against the histogram, rounded down to
what is there. What stays over is packed greedily, longest first. All that the driver holds has the size of the
window, whatever the number of documents: patterns, and the ranks of each length that a pattern takes.

The rank of a piece among those of its length is the number of such pieces in earlier shards plus its place in its own
shard, so every task places its own pieces and no token moves.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.llm.tokens import END_ID, Shard, over_shards, read_manifest, write_tokens
from riskflow.session import materialise, scratch_path

WINDOW = 2048
ANCHORS = 12
SWEEPS = 25


def combinations(histogram: dict[int, int], window: int = WINDOW, anchors: int = ANCHORS) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths of the histogram that sum to ``window``. Triples have one of ``anchors`` lengths,
    spread evenly over the pieces; so there are at most ``anchors`` times as many as lengths."""
    lengths = sorted(n for n, count in histogram.items() if count > 0 and n < window)
    there = set(lengths)
    found = {(a, window - a) for a in lengths if a <= window - a and window - a in there}
    found |= {(window // 2,) * 2} if window % 2 == 0 and window // 2 in there else set()
    if lengths:
        steps = np.cumsum([histogram[n] for n in lengths])
        at = np.searchsorted(steps, np.linspace(0, steps[-1], anchors + 2)[1:-1])
        for b in {lengths[int(i)] for i in at}:
            found |= {tuple(sorted((a, b, window - a - b))) for a in lengths if window - a - b in there}
    return sorted(found)


def least_squares(patterns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Repeats x >= 0 that minimise the squared difference of what the patterns use and the histogram, by coordinate
    descent: each step is the exact minimum in one coordinate, cut at zero."""
    rest = {n: float(count) for n, count in histogram.items()}
    columns = [list(Counter(p).items()) for p in patterns]
    norms = [sum(m * m for _, m in c) for c in columns]
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for i, column in enumerate(columns):
            new = max(0.0, x[i] + sum(m * rest[n] for n, m in column) / norms[i])
            step = new - x[i]
            if step:
                x[i] = new
                moved = max(moved, abs(step))
                for n, m in column:
                    rest[n] -= step * m
        if moved < 0.5:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): every piece of the histogram in exactly one sequence. Lengths go from 1 to ``window``."""
    left = {n: count for n, count in histogram.items() if count > 0}
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        chosen.append((pattern, times))
        for n, m in Counter(pattern).items():
            left[n] -= m * times
            if not left[n]:
                del left[n]

    if window in left:
        take((window,), left[window])
    patterns = combinations(left, window)
    wanted = least_squares(patterns, left)
    for i in sorted(range(len(patterns)), key=lambda i: -wanted[i]):
        most = min(left.get(n, 0) // m for n, m in Counter(patterns[i]).items())
        if times := min(round(wanted[i]), most):
            take(patterns[i], times)
    lengths = sorted(left)
    while lengths:
        pattern, space, used = [], window, Counter()
        while space and (at := bisect_right(lengths, space)):
            at -= 1
            while at >= 0 and used[lengths[at]] >= left[lengths[at]]:
                at -= 1
            if at < 0:
                break
            n = lengths[at]
            times = min(space // n, left[n] - used[n])
            pattern += [n] * times
            used[n] += times
            space -= n * times
        take(tuple(pattern), min(left[n] // m for n, m in used.items()))
        lengths = [n for n in lengths if n in left]
    return chosen


class Slots:
    """Sequence and offset of the k-th piece of a length, for the patterns of a plan."""

    def __init__(self, chosen: list[tuple[tuple[int, ...], int]]) -> None:
        ranks: Counter = Counter()
        rows = []
        sequence = 0
        for pattern, times in chosen:
            offset = 0
            for n, m in sorted(Counter(pattern).items(), reverse=True):
                rows.append((n, ranks[n], m, sequence, offset))
                ranks[n] += m * times
                offset += n * m
            sequence += times
        self.sequences = sequence
        self._table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths, first, per, sequence, offset = self._table.T
        big = np.int64(1) << np.int64(48)
        at = np.searchsorted(lengths * big + first, length * big + rank, side="right") - 1
        inside = rank - first[at]
        return sequence[at] + inside // per[at], offset[at] + inside % per[at] * length


def _pieces(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece of documents of such lengths."""
    count = -(-lengths // window)
    document = np.repeat(np.arange(len(lengths)), count)
    start = (np.arange(len(document)) - np.repeat(np.cumsum(count) - count, count)) * window
    return document, start, np.minimum(lengths[document] - start, window)


_PLACED = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
)


def pack_shards(spark: SparkSession, path: str, window: int = WINDOW) -> DataFrame:
    """Place every piece of the token files at ``path``: doc_id, start, length, doc_tokens, sequence_id, offset, ids
    (little-endian unsigned 32-bit). A document with n ids has ceil(n / window) pieces, all but the last whole windows."""
    numbers = [s["shard"] for s in read_manifest(path)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                lengths = np.diff(Shard.open(path, numbers[at]).offsets)
                found, times = np.unique(_pieces(lengths, window)[2], return_counts=True)
                yield pa.RecordBatch.from_pydict({"at": [at] * len(found), "length": found, "pieces": times})

    counts = materialise(
        over_shards(spark, numbers).mapInArrow(count, "at bigint, length bigint, pieces bigint"), "lengths"
    )
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}
    slots = Slots(plan(total, window))
    earlier = Window.partitionBy("length").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        counts.withColumn("before", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)))
        .groupBy("at")
        .agg(F.sort_array(F.collect_list(F.struct("length", "before"))).alias("before"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _placed(Shard.open(path, numbers[row["at"]]), row["before"], slots, window)

    # A number of one's own: adaptive execution would put these few rows, and with them all files, into one task.
    return bases.repartitionByRange(max(1, len(numbers)), "at").mapInArrow(place, _PLACED)


def _placed(shard: Shard, before: list[dict], slots: Slots, window: int) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(shard.offsets)
    document, start, length = _pieces(sizes, window)
    order = np.argsort(length, kind="stable")
    place = np.empty(len(length), np.int64)
    place[order] = np.arange(len(length)) - np.searchsorted(length[order], length[order])
    known = np.array([b["length"] for b in before])
    base = np.array([b["before"] for b in before])
    sequence, offset = slots.find(length, base[np.searchsorted(known, length)] + place)
    keys = shard.key_array()
    for first in range(0, len(document), 512):
        s = slice(first, first + 512)
        starts = shard.offsets[document[s]] + start[s]
        ids = [shard.ids[a : a + n].astype("<u4").tobytes() for a, n in zip(starts, length[s], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(document[s])), *map(pa.array, (start[s], length[s], sizes[document[s]], sequence[s], offset[s])), pa.array(ids, pa.binary())],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode, append the end id, write token files to the shared folder and place their pieces.

    Null texts are empty and have the end id alone; null keys stay null; repeated rows are documents of their own; an empty
    table gives no pieces. Other columns aren't read.
    """
    path = scratch_path(docs.sparkSession, "packed")
    write_tokens(docs, path, tokenizer, end_id, key, text, ordered=False)
    return pack_shards(docs.sparkSession, path, window)
