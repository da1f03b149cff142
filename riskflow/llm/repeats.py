"""Removal of repeated passages: every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere.

A window is a string of ``LENGTH`` bytes inside one text. Whether a window repeats is decided by suffix arrays; what goes before
brings the windows together that can be equal, and leaves out what cannot repeat:

1. The anchor of a window is the smallest of its ``GRAM``-byte hashes, leftmost on ties. Equal windows have equal anchors at
   the same offset. Neighbouring windows with one anchor form a segment, one row. Anchors that occur once are dropped.
2. Segments that are equal byte for byte are one class with a weight; a class of weight two or more repeats as a whole.
3. Classes that differ but share the anchor are cut into blocks of windows at fixed offsets from it. All windows of a block contain its
   core, so blocks with equal windows have equal cores. Again equal blocks are one with a weight.
4. Blocks with one core that differ are put behind one another, the core as one code, and sorted by a suffix array; neighbours
   in it that agree in ``LENGTH`` bytes repeat. Where very many meet at one core, the same step is taken with smaller blocks, down
   to single windows, which are equal or not; so no task gets a group without a bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import RollingHash, bytes_of, mix, slices
from riskflow.llm.suffix_array import suffix_array
from riskflow.session import materialise

LENGTH = 400
GRAM = 200
BLOCKS = (64, 8, 1)
GROUP = 512
#: Bytes of text that a task turns into numbers at once, some 60 bytes for each; runs that it holds before it hands them on.
SLICE = 1 << 18
HELD = 10_000
_POSITION = np.uint64(30)


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` values; the values hold their place in the low bits."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & ((np.uint64(1) << _POSITION) - np.uint64(1))).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, anchor hash, class hash, first window, last window, anchor) of each segment, places counted in the buffer."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    rolling = RollingHash(data, least=SLICE)
    grams = mix(rolling.windows(gram))
    places = np.arange(len(grams), dtype=np.uint64)
    anchors = _sliding_argmin((grams >> _POSITION << _POSITION) | places, length - gram + 1)
    starts = np.arange(len(anchors))
    text = np.searchsorted(offsets, starts, side="right") - 1
    valid = starts + length <= offsets[text + 1]
    begins = valid.copy()
    begins[1:] &= (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(begins)
    breaks = np.append(np.flatnonzero(begins | ~valid), len(anchors))
    last = breaks[np.searchsorted(breaks, first, side="right")] - 1
    anchor = anchors[first]
    shape = mix(((anchor - first) << 32 | (last - first)).astype(np.uint64))
    kind = mix(rolling.of(first, last + length) ^ shape)
    return text[first], grams[anchor], kind, first, last, anchor


_ROWS = "anchor bigint, kind bigint, id bigint, tie bigint, low int, high int, at int"


def _segment_rows(chosen: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offsets = bytes_of(batch.column("text"))
            text, anchor, kind, first, last, at = segments(data, offsets, length, gram)
            base = offsets[text]
            taken = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.astype(np.int64)), pa.array(kind.astype(np.int64)), batch.column("id").take(taken), batch.column("tie").take(taken),
                    *(pa.array((x - base).astype(np.int32)) for x in (first, last, at)),
                ],
                names=["anchor", "kind", "id", "tie", "low", "high", "at"],
            )

    return chosen.mapInArrow(run, _ROWS)


def _with_cuts(chosen: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, cuts): each text that one of the wanted classes is cut from, with those cuts."""
    lists = wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("anchor", "kind", "weight", "low", "high", "at")).alias("cuts"))
    joined = chosen.join(lists.withColumnRenamed("id", "i").withColumnRenamed("tie", "t"), F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
    return joined.select("text", "cuts")


_TEXT = ["anchor", "kind", "weight", "low", "at", "text"]


def _segment_texts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(anchor, kind, weight, low, at, text): the bytes of each wanted class. ``at`` is the anchor's place among them, ``low`` 0."""
    for batch in slices(batches, "text", SLICE):
        cuts = batch.column("cuts")
        owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(cuts).to_numpy(zero_copy_only=False))
        anchor, kind, weight, low, high, at = cuts.flatten().flatten()
        first, end = low.to_numpy(), high.to_numpy() + length
        texts = batch.column("text").to_pylist()
        cut = [texts[i][x:y] for i, x, y in zip(owner.tolist(), first.tolist(), end.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [anchor, kind, weight, pa.array(np.zeros(len(cut), np.int32)), pa.array(at.to_numpy() - first), pa.array(cut, pa.binary())], names=_TEXT
        )


_BLOCK = ["core", "block", "weight", "anchor", "kind", "low", "at", "text"]
_BLOCKS = "core bigint, block bigint, weight bigint, anchor bigint, kind bigint, low int, at int, text binary"


def _edge(at, width: int):
    """Start of the first block of a text whose anchor is at ``at``: at most 0, a multiple of ``width`` before the place behind the anchor."""
    return -(-(at + 1) % width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """(core, block, weight, anchor, kind, low, at, text): the windows of each segment by blocks of ``width`` starts, counted from
    the anchor. ``low`` is the block's first window in the segment."""
    for batch in slices(batches, "text", SLICE * min(width, 8) // 8):
        data, offsets = bytes_of(batch.column("text"))
        rolling = RollingHash(data, least=SLICE)
        anchor, kind, weight, low, at = (batch.column(n).to_numpy() for n in _TEXT[:-1])
        last, edge = np.diff(offsets) - length, _edge(at.astype(np.int64), width)
        counts = (last - edge) // width + 1
        row = np.repeat(np.arange(len(counts)), counts)
        cuts = edge[row] + width * (np.arange(len(row)) - (np.cumsum(counts) - counts)[row])
        first, end = np.maximum(cuts, 0), np.minimum(cuts + width - 1, last[row])
        base = offsets[row]
        shape = mix((cuts - at[row] + length).astype(np.uint64) ^ (anchor[row] & ((1 << 63) - 1)).astype(np.uint64))
        # The part that all windows of the whole block contain lies in each of them, so also in this text.
        core = mix(rolling.of(base + cuts + width - 1, base + cuts + length) ^ shape)
        block = mix(rolling.of(base + first, base + end + length) ^ mix(((first - cuts) << 32 | (end - cuts)).astype(np.uint64)) ^ core)
        whole = data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(x.astype(np.int64)) for x in (core, block, weight[row], anchor[row], kind[row])),
                *(pa.array(x.astype(np.int32)) for x in (low[row] + first, at[row] - first)),
                pa.array([whole[x:y] for x, y in zip((base + first).tolist(), (base + end + length).tolist(), strict=True)], pa.binary()),
            ],
            names=_BLOCK,
        )


def repeated_windows(texts: list[bytes], starts: list[int], core: int, length: int) -> list[list[int]]:
    """For each text the starts of its windows that occur in another of the texts.

    At ``starts`` the texts have a core of so many bytes, the same in all, that lies in each window and at one place in equal
    windows. It is one code to the suffix array.
    """
    joined: list[int] = []
    owner: list[int] = []
    opens = []
    for i, (text, start) in enumerate(zip(texts, starts, strict=True)):
        opens.append(len(joined))
        joined.extend(b + 2 for b in text[:start])
        joined.append(1)
        joined.extend(b + 2 for b in text[start + core :])
        joined.append(0)
        owner.extend([i] * (len(joined) - len(owner)))
    found: list[set[int]] = [set() for _ in texts]
    before = None
    for s in suffix_array(joined):
        i = owner[s]
        at = s - opens[i]
        if at + length > len(texts[i]) or at > starts[i]:
            continue
        window = texts[i][at : at + length]
        if before is not None and window == before[0]:
            found[i].add(at)
            found[before[1]].add(before[2])
        before = (window, i, at)
    return [sorted(f) for f in found]


def _edges(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """(core, block, first, last): runs of repeated windows in the distinct blocks of each core; rows of a core come together."""

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["core", "block", "first", "last"])

    rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("core", "block", "at", "text")), strict=True))
    size = length - width + 1
    out: list[tuple[int, int, int, int]] = []
    for core, group in groupby(rows, key=itemgetter(0)):
        alike: dict[bytes, list[tuple[int, int, bytes]]] = {}  # cores are equal by their hash; here their bytes decide
        for _, block, at, text in group:
            start = _edge(at, width) + width - 1
            alike.setdefault(text[start : start + size], []).append((block, start, text))
        for members in alike.values():
            blocks, starts, texts = (list(x) for x in zip(*members, strict=True))
            for block, windows in zip(blocks, repeated_windows(texts, starts, size, length), strict=True):
                for k, s in enumerate(windows):
                    if k and windows[k - 1] == s - 1:
                        out[-1] = (core, block, out[-1][2], s)
                    else:
                        out.append((core, block, s, s))
        if len(out) >= HELD:
            yield batch()
            out = []
    yield batch()


def _decided(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, kind, first, last): runs of repeated windows of the segments cut from ``texts``."""
    session = texts.sparkSession
    done = session.createDataFrame([], "anchor bigint, kind bigint, first int, last int")
    read = partial(_segment_texts, length=length)
    for width in (w for w in BLOCKS if w <= length):
        # Segments are cut and split in one pass, so a core has one Python process.
        blocks = materialise(texts.mapInArrow(lambda b, read=read, width=width: _blocks(read(b), width, length), _BLOCKS), "blocks")
        kinds = blocks.groupBy("core", "block").agg(F.sum("weight").alias("weight"))
        cores = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("weight").alias("total")).where("total > 1")
        kinds = materialise(kinds.withColumnRenamed("weight", "copies").join(cores, "core"), "kinds")
        many = kinds.where("copies > 1").select("core", "block")
        span = F.length("text") - F.lit(length)
        whole = blocks.join(many, ["core", "block"]).select("anchor", "kind", F.col("low").alias("first"), (F.col("low") + span).alias("last"))
        done = done.unionByName(whole)
        few = kinds.where(f"kinds > 1 AND kinds <= {GROUP}").select("core", "block")
        single = blocks.join(few, ["core", "block"]).groupBy("core", "block").agg(F.first("at").alias("at"), F.first("text").alias("text"))
        grouped = single.repartition("core").sortWithinPartitions("core")
        runs = grouped.mapInArrow(lambda b, width=width: _edges(b, width, length), "core bigint, block bigint, first int, last int")
        edges = blocks.select("core", "block", "anchor", "kind", "low").join(materialise(runs, "runs"), ["core", "block"])
        done = done.unionByName(edges.select("anchor", "kind", (F.col("low") + F.col("first")).alias("first"), (F.col("low") + F.col("last")).alias("last")))
        texts, read = blocks.join(kinds.where(f"kinds > {GROUP}").select("core", "block"), ["core", "block"]).select(*_TEXT), iter
        if width == 1 or kinds.where(f"kinds > {GROUP}").isEmpty():
            return done
    return done


def covered(chosen: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, tie, spans) of the documents with repeated windows; spans are [start, end) in bytes, neither sorted nor merged."""
    rows = materialise(_segment_rows(chosen, length, gram), "segments")
    classes = rows.groupBy("anchor", "kind").agg(
        F.count("*").alias("weight"), *(F.first(c).alias(c) for c in ("id", "tie", "low", "high", "at"))
    )
    anchors = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.sum("weight").alias("total")).where("total > 1")
    classes = materialise(classes.join(anchors, "anchor"), "classes")
    whole = classes.where("weight > 1").select("anchor", "kind", F.lit(0).alias("first"), (F.col("high") - F.col("low")).alias("last"))
    texts = _with_cuts(chosen, classes.where("classes > 1"))
    # A class that repeats as a whole needs no decision, but is there for others to be compared with.
    decided = _decided(texts, length).unionByName(whole)
    lists = decided.groupBy("anchor", "kind").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    spans = rows.join(lists, ["anchor", "kind"]).select(
        "id", "tie",
        F.transform("runs", lambda r: F.struct((F.col("low") + r["first"]).alias("start"), (F.col("low") + r["last"] + length).alias("end"))).alias("spans"),
    )
    # Equal rows have equal segments, so equal spans: held once, not once for each row.
    return spans.groupBy("id", "tie").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, spans (array of start, end: the removed bytes) and kept (the other bytes).

    Texts are UTF-8 bytes, null is empty; matches don't cross documents and are judged on the input. Texts shorter than
    ``length`` stay as they are. Repeated rows are documents that repeat each other. Other columns aren't read.
    """
    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    chosen = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.xxhash64(raw).alias("tie"), raw.alias("text"))
    spans = covered(chosen, length, gram).withColumnRenamed("id", "i").withColumnRenamed("tie", "t")
    joined = chosen.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 * SLICE):
            spans = batch.column("spans")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)).tolist()
            starts, stops = (x.to_numpy().tolist() for x in spans.flatten().flatten())
            removed, kept = [], []
            for raw, x, y in zip(batch.column("text").to_pylist(), [0, *ends], ends, strict=False):
                gone = merged(zip(starts[x:y], stops[x:y], strict=True))
                edges = [0, *(e for span in gone for e in span), len(raw)]
                removed.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(batch.column("text")), pa.int64()), pa.array(removed, _SPANS), pa.array(kept, pa.binary())],
                names=[key, "n_bytes", "spans", "kept"],
            )

    return joined.select("id", "text", "spans").mapInArrow(
        cut, f"`{key}` bigint, n_bytes bigint, spans array<struct<start: int, end: int>>, kept binary"
    )


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
