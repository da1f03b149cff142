"""Jaccard join on word shingles: exact links between documents, and the components that they form.

1. Documents with equal sets of shingles are one node. A pass over the texts gives each document its node, and with it
   a bitmap of the set and a table of counts by hashed bucket, of fixed size, that orders shingles from rare to common.
2. Two sets with a Jaccard similarity of t share a shingle among the first ``size - ceil(t * size) + 1`` of each in any
   common order. Those shingles (keys) meet in a shuffle; as rare ones come first, few documents meet at each.
3. Where documents of different components meet, they are compared in tiles of size bands: members in order of size, each with those
   within the ratio t. The places of the key in both sets bound the overlap from above at their first common key, and so do the
   bits in which their bitmaps differ. A bitmap holds the parities of hashed shingles and is as wide as its set is large,
   so the bound stays sharp at any size. Pairs that may link are verified by intersecting their sorted arrays of shingles.

Keys of few nodes give their pairs at once. Those of many are first tried in rounds: each node with the one that it meets most
often, then each component at a key with the partner of the best bound, until a round links nothing new. That settles groups of near copies with a test or
two a member. Then all pairs of different components that still meet are tried. Pairs are given at their first common key, but for some
repetitions. No link between different components is left out, so the components are those of all links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import bytes_of, keep_rows, mix, row_identity, run_hashes, slices, word_bounds
from riskflow.llm.components import components
from riskflow.session import materialise, scratch_path, scratch_scope

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
#: Sets up to this size have two to four bits of bitmap a shingle, larger ones one to two.
WIDE = 4096
BUCKET_BITS = 24
PARTS = 64
#: Keys of so many nodes or fewer give all pairs where they meet.
SMALL = 8
#: Rows of a key in order of size that are compared as one block with another.
BLOCK = 4096
#: Keys just before a row's own that tell whether a pair was given there.
EARLIER = 8
TILE = 1024
#: Bits of the bitmap that tells which texts may be wanted.
FILTER_BITS = 25

_STEP = mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, and where each text's begin (one more at the end).

    Words are runs without white space (0x20, 0x09-0x0D), lower-cased in A-Z. A text of fewer than ``words`` words has one
    shingle, all of them; one without words has none.
    """
    starts, ends, first = word_bounds(data, offsets)
    hashes = run_hashes(data, starts, ends, lower=True)
    count = np.diff(first)
    shingles = np.maximum(count - words + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), shingles)
    at = np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[:-1][text]
    length = np.minimum(count, words)[text]
    padded = np.concatenate((hashes, np.zeros(words, np.uint64)))
    total = mix(length.astype(np.uint64))
    for j in range(words):
        total += np.where(length > j, padded[at + j] * _STEP[j], np.uint64(0))
    total = mix(total)
    order = np.lexsort((total, text))
    total, text = total[order], text[order]
    new = np.ones(len(total), dtype=bool)
    new[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    return total[new], np.searchsorted(text[new], np.arange(len(count) + 1))


def _node(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """63-bit digest of each set: a sum over its members and its size."""
    size = np.diff(first)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x51ED270B9F3A1C77)))))
    total = sums[first[1:]] - sums[first[:-1]]
    return (mix(total + size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _widths(size: np.ndarray) -> np.ndarray:
    """Bits of the bitmaps of sets of such sizes: powers of two that never fall with the size."""
    least = np.where(size <= WIDE, 2 * size, size).clip(64)
    return np.int64(1) << np.ceil(np.log2(least)).astype(np.int64)


def _bitmaps(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set the parity of its shingles by hashed bit."""
    size = np.diff(first)
    width = _widths(size)
    ends = np.cumsum(width)
    at = np.repeat(ends - width, size) + (values & (np.repeat(width, size) - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(width.sum())) & 1).astype(bool)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip((ends - width).tolist(), ends.tolist(), strict=True)]


_BUCKETS = 1 << BUCKET_BITS


def _bucket(values: np.ndarray) -> np.ndarray:
    return values >> np.uint64(64 - BUCKET_BITS)


def _nodes(docs: DataFrame, words: int) -> DataFrame:
    """Rows (id, tie, node, size, bitmap) of documents, and rows (part, counts) of each task's bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[np.ndarray] = []
        for batch in slices(batches, "text"):
            values, first = shingle_sets(*bytes_of(batch.column("text")), words)
            met.append(_bucket(values).astype(np.uint32))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("tie"), pa.array(_node(values, first)), pa.array(np.diff(first)),
                    pa.array(_bitmaps(values, first), pa.binary()),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                ],
                names=_NODE_NAMES,
            )
        if met:
            counts = np.zeros(_BUCKETS, np.uint8)
            found, times = np.unique(np.concatenate(met), return_counts=True)
            counts[found] = np.minimum(times, 255)
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, PARTS)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.nulls(PARTS, pa.int64()) for _ in range(4)), pa.nulls(PARTS, pa.binary()),
                    pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary()),
                ],
                names=_NODE_NAMES,
            )

    return docs.mapInArrow(run, "id bigint, tie bigint, node bigint, size bigint, bitmap binary, part int, counts binary")


_NODE_NAMES = ["id", "tie", "node", "size", "bitmap", "part", "counts"]


def _bucket_ranks(nodes: DataFrame) -> np.ndarray:
    """Rank of each bucket from rare to common, in quarter octaves of its count so that chance differences hardly matter.

    All tasks' counts are added up part by part on the executors; what comes to the driver has a fixed size.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.uint8).astype(np.int32)
        ranks = [np.round(4 * np.log2(1.0 + s)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], names=["part", "ranks"])

    parts = nodes.where("part IS NOT NULL").select("part", "counts")
    found = parts.repartition(PARTS, "part").mapInArrow(add, "part int, ranks binary").collect()  # PARTS rows
    total = np.zeros((PARTS, _BUCKETS // PARTS), np.uint8)
    for row in found:
        total[row.part] = np.frombuffer(row.ranks, np.uint8)
    return total.ravel()


def _prefixes(docs: DataFrame, ranks: np.ndarray, words: int) -> DataFrame:
    """(key, node, extent) for the shingles of each set's prefix, once a task for each node. ``extent`` is the size of
    the set in the upper and the place of the shingle in the lower 32 bits."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            values, first = shingle_sets(*bytes_of(batch.column("text")), words)
            nodes, size = _node(values, first), np.diff(first)
            keep = np.zeros(len(nodes), dtype=bool)
            for i, node in enumerate(nodes.tolist()):
                if size[i] and node not in seen:
                    seen.add(node)
                    keep[i] = True
            text = np.repeat(np.arange(len(nodes)), size)
            ordered = (rank[_bucket(values).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
            order = np.lexsort((ordered, text))
            place = np.arange(len(text)) - first[:-1][text]
            prefix = size + (size * -NUMERATOR // DENOMINATOR) + 1  # size - ceil(t * size) + 1
            taken = (place < prefix[text]) & keep[text]
            chosen = order[taken]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(values[chosen].astype(np.int64)), pa.array(nodes[text[chosen]]),
                    pa.array((size[text[chosen]] << 32) | place[taken]),
                ],
                names=["key", "node", "extent"],
            )

    return docs.mapInArrow(run, "key bigint, node bigint, extent bigint")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that come in order of the columns ``by``."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in by]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if rest and any(rest[-1].column(c)[-1].as_py() != v[0] for c, v in zip(by, columns, strict=True)):
            yield pa.Table.from_batches(rest)
            rest = []
        if len(starts):
            yield pa.Table.from_batches([*rest, batch.slice(0, int(starts[-1]))])
            rest, batch = [], batch.slice(int(starts[-1]))
        rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


_MEETING_NAMES = ["key", "node", "extent", "block", "other"]
_MEETING = "key bigint, node bigint, extent bigint, block int, other bigint"


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, extent, node): pairs (node, other) of keys with few nodes that may link, and the rows
    of keys with more, each (key, node) once with its block."""
    for table in _groups(batches, ["key"]):
        key, node, extent = (table.column(n).to_numpy() for n in ("key", "node", "extent"))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, extent = key[new], node[new], extent[new]
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        count = np.repeat(np.diff(edges), np.diff(edges))
        few = np.flatnonzero((count > 1) & (count <= SMALL))
        found = []
        for step in range(1, SMALL):
            x, y = few[:-step], few[step:]
            fine = key[x] == key[y]
            x, y = x[fine], y[fine]
            fine = _may_meet(extent[x], extent[y])
            found.append(np.sort(np.stack([node[x[fine]], node[y[fine]]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.nulls(len(pairs), pa.int64()),
                pa.nulls(len(pairs), pa.int32()), pa.array(pairs[:, 1]),
            ],
            names=_MEETING_NAMES,
        )
        many = np.flatnonzero(count > SMALL)
        block = (np.arange(len(key)) - np.repeat(edges[:-1], np.diff(edges))) // BLOCK
        for at in range(0, len(many), 50_000):
            some = many[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[some]) for c in (key, node, extent)), pa.array(block[some].astype(np.int32)), pa.nulls(len(some), pa.int64())],
                names=_MEETING_NAMES,
            )


def _may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of such sizes can have the similarity at all."""
    return np.minimum(a, b) * DENOMINATOR >= NUMERATOR * np.maximum(a, b)


def _may_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets can link whose first common shingle has these extents: what comes before it isn't shared."""
    s, t = a >> 32, b >> 32
    overlap = np.minimum(s - (a & 0xFFFFFFFF), t - (b & 0xFFFFFFFF))
    return _may_link(s, t) & _enough(overlap, s, t)


def _enough(overlap, a_size, b_size):
    """100 * intersection >= 75 * union."""
    return DENOMINATOR * overlap >= NUMERATOR * (a_size + b_size - overlap)


class _Bitmaps:
    """Bitmaps of several widths, those of one width in a matrix."""

    def __init__(self, bitmaps: list[bytes]) -> None:
        length = np.array([len(b) for b in bitmaps], dtype=np.int64)
        self.words = length // 8
        self._row = np.zeros(len(bitmaps), dtype=np.int64)
        self._of: dict[int, np.ndarray] = {}
        for words in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == words)
            self._row[own] = np.arange(len(own))
            self._of[words] = np.frombuffer(b"".join([bitmaps[i] for i in own.tolist()]), np.uint64).reshape(-1, words)

    def _rows(self, at: np.ndarray, words: int, narrow: int) -> np.ndarray:
        rows = self._of[words][self._row[at]]
        while rows.shape[1] > narrow:  # a parity of half the width is that of two bits
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        return rows

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair the number of bits that differ in the narrower width: a lower bound of the shingles in one set alone."""
        found = np.zeros(len(x), dtype=np.int64)
        kinds = self.words[x] * (1 << 40) + self.words[y]
        for kind in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == kind)
            wide = kind >> 40, kind & ((1 << 40) - 1)
            step = max(1, (1 << 20) // max(wide))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                p, q = self._rows(x[some], wide[0], min(wide)), self._rows(y[some], wide[1], min(wide))
                found[some] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
        return found


def _tiles(extent: np.ndarray, root: np.ndarray, block: np.ndarray, bits: _Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (x, y) of members in order of size and the bounds of their overlaps, for those with different roots that places
    and bitmaps allow. Members of the most frequent root aren't compared with one another; with two blocks only pairs across count."""
    _, codes, counts = np.unique(root, return_inverse=True, return_counts=True)
    is_outside = codes != counts.argmax()
    outside = np.flatnonzero(is_outside)
    size = extent >> 32
    across = bool((block != block[0]).any())
    for at in range(0, len(outside), TILE):
        a = outside[at : at + TILE]
        low = int(np.searchsorted(size, -(-size[a[0]] * NUMERATOR // DENOMINATOR)))
        high = int(np.searchsorted(size, size[a[-1]] * DENOMINATOR // NUMERATOR, side="right"))
        for j in range(low, high, TILE):
            b = np.arange(j, min(j + TILE, high))
            allowed = (codes[a][:, None] != codes[b]) & (~is_outside[b] | (b > a[:, None])) & _may_meet(extent[a][:, None], extent[b])
            if across:
                allowed &= block[a][:, None] != block[b]
            x, y = np.nonzero(allowed)
            x, y = a[x], b[y]
            overlap = (size[x] + size[y] - bits.differing(x, y)) // 2
            fine = _enough(overlap, size[x], size[y])
            if fine.any():
                yield x[fine], y[fine], overlap[fine]


def _compare(best: bool):
    """Pairs (a, b) of nodes that may link, from rows in order of (key, i, j, extent): those of the best bound for each root at
    a key, or all that weren't given at one of the ``EARLIER`` keys before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["key", "i", "j"]):
            key, i, j, node, extent, block, root = (table.column(n).to_numpy() for n in ("key", "i", "j", "node", "extent", "block", "root"))
            bitmaps = table.column("bitmap").to_pylist()
            before = np.zeros((len(key), EARLIER), np.int64)
            for row, keys in enumerate(table.column("before").to_pylist()):
                before[row, : len(keys)] = keys
            cut = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            edges = np.flatnonzero(np.concatenate(([True], cut, [True])))
            found: set[tuple[int, int]] = set()
            for p, q in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = slice(p, q)
                if (root[own] == root[p]).all():
                    continue
                tops: dict[int, tuple[float, int, int]] = {}
                for x, y, overlap in _tiles(extent[own], root[own], block[own], _Bitmaps(bitmaps[p:q])):
                    x, y = x + p, y + p
                    if best:
                        size = (extent[x] >> 32) + (extent[y] >> 32)
                        score = overlap / (size - overlap)
                        order = np.argsort(-score, kind="stable")
                        for ends in (x[order], y[order]):
                            roots, at = np.unique(root[ends], return_index=True)
                            for r, k in zip(roots.tolist(), order[at].tolist(), strict=True):
                                one = (float(score[k]), int(node[x[k]]), int(node[y[k]]))
                                tops[r] = max(one, tops.get(r, one))
                    else:
                        here = before[x]
                        given = ((here[:, :, None] == before[y][:, None, :]) & (here[:, :, None] != 0)).any(axis=(1, 2))
                        found.update(zip(node[x[~given]].tolist(), node[y[~given]].tolist(), strict=True))
                found.update((a, b) for _, a, b in tops.values())
                if len(found) > 50_000:
                    yield _pair_batch(found)
                    found = set()
            if found:
                yield _pair_batch(found)

    return run


def _pair_batch(pairs: set) -> pa.RecordBatch:
    both = np.sort(np.array(list(pairs), dtype=np.int64), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _perhaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id may be one of ``wanted``: a bitmap of fixed size by hashed id tells, so no text is shuffled."""
    place = F.xxhash64("id").bitwiseAND((1 << FILTER_BITS) - 1) + 1
    found = wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    spot = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return docs.join(F.broadcast(found), (F.bitmap_bucket_number(place) == F.col("bucket")) & (F.getbit(byte, (spot % 8).cast("int")) == 1))


def _verified(pairs: DataFrame, docs: DataFrame, sample: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link, by intersecting their arrays. ``sample`` has one document (id) of each
    node; only the texts of nodes in pairs, and the few that share a bit with one, become arrays."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, first = shingle_sets(*bytes_of(batch.column("text")), words)
            held = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_node(values, first)), pa.array(held, pa.binary())], names=["node", "shingles"])

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((a, b)), kind="stable")
                good.append(bool(_enough(int((both[1:] == both[:-1]).sum()), len(a), len(b))))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    spark = pairs.sparkSession
    path = scratch_path(spark, "links")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _perhaps(docs, ends.join(sample, "node").select("id")).select("text")
    with scratch_scope(spark):  # the arrays are as large as the texts and read here alone
        sets = materialise(texts.mapInArrow(arrays, "node bigint, shingles binary"), "shingles")
        joined = (
            pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        )
        return materialise(joined.select("a", "b", "x", "y").mapInArrow(intersect, "a bigint, b bigint"), "links", path)


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that the bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s, t = batch.column("s").to_numpy(), batch.column("t").to_numpy()
                bits = _Bitmaps(batch.column("p").to_pylist() + batch.column("q").to_pylist())
                at = np.arange(len(s))
                fine = _enough((s + t - bits.differing(at, at + len(s))) // 2, s, t)
                yield batch.select(["a", "b"]).filter(pa.array(fine))

    a = nodes.select(F.col("node").alias("a"), F.col("size").alias("s"), F.col("bitmap").alias("p"))
    b = nodes.select(F.col("node").alias("b"), F.col("size").alias("t"), F.col("bitmap").alias("q"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "s", "t", "p", "q").mapInArrow(run, "a bigint, b bigint")


def _compared(rooted: DataFrame, nodes: DataFrame, best: bool) -> DataFrame:
    """Pairs of nodes of different components at keys of many nodes, see ``_compare``. A key of more than ``BLOCK`` rows is
    dealt out by pairs of its blocks."""
    before = F.collect_list("key").over(Window.partitionBy("node").orderBy("place", "key").rowsBetween(-EARLIER, -1))
    rows = rooted.withColumn("place", F.col("extent").bitwiseAND(0xFFFFFFFF)).withColumn("before", before)
    rows = rows.join(nodes.select("node", "bitmap"), "node")
    dealt = rows.withColumn("with", F.explode(F.sequence(F.lit(0), "last"))).select(
        "key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "extent", "block", "root", "bitmap", "before"
    )
    return (
        dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "extent", "node")
        .mapInArrow(_compare(best), "a bigint, b bigint").distinct()
    )


def _open_keys(rooted: DataFrame) -> DataFrame:
    """(key, low, last) of keys at which nodes of different components meet: the smallest component and the last block."""
    ends = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("block").alias("last"))
    return ends.where("low <> high").select("key", "low", "last")


def _often_met(rooted: DataFrame) -> DataFrame:
    """(a, b): each node with that node of another component which it meets most often, of one node a key."""
    keyed = rooted.join(_open_keys(rooted), "key")
    hubs = keyed.where("root = low").groupBy("key").agg(F.min("node").alias("hub"))
    return (
        keyed.where("root <> low").join(hubs, "key").groupBy("node", "hub").agg(F.count("*").alias("times"))
        .groupBy("node").agg(F.max(F.struct("times", "hub")).alias("best"))
        .select(F.least("node", "best.hub").alias("a"), F.greatest("node", "best.hub").alias("b")).distinct()
    )


def jaccard_nodes(docs: DataFrame, key: str, text: str, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Documents (id, tie, node, size) and components (node, root) of the nodes that have links."""
    chosen = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("id"), row_identity(key, text)[2].alias("tie"), F.col(f"`{text}`").cast("binary").alias("text")
    )
    every = materialise(_nodes(chosen, words), "nodes")
    documents = every.where("part IS NULL").select("id", "tie", "node", "size")
    nodes = materialise(
        every.where("part IS NULL AND size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), F.min("id").alias("id")), "nodes"
    )
    sample = nodes.select("node", "id")
    prefixes = _prefixes(chosen, _bucket_ranks(every), words)
    met = materialise(
        prefixes.repartition("key").sortWithinPartitions("key", "extent", "node").mapInArrow(_meetings, _MEETING), "meetings"
    )
    few = met.where("key IS NULL").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    direct = materialise(_bounded(few, nodes), "pairs")
    rooted = met.where("key IS NOT NULL").select("key", "node", "extent", "block", F.col("node").alias("root"))

    # One partner for each node: that which it meets most often, or one of the few that share a key.
    first = _bounded(_often_met(rooted), nodes).unionByName(direct.groupBy("b").agg(F.min("a").alias("a")))
    tried = materialise(first.distinct(), "pairs")
    links = _verified(tried, chosen, sample, words)
    best, roots = True, components(links)
    while True:
        now = rooted.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = materialise(now.join(_open_keys(now).select("key", "last"), "key"), "meetings")
        pairs = _compared(rooted, nodes, best)
        if direct is not None:
            apart = direct.join(roots.toDF("a", "p"), "a", "left").join(roots.toDF("b", "q"), "b", "left")
            pairs = pairs.unionByName(apart.where("coalesce(p, a) <> coalesce(q, b)").select("a", "b")).distinct()
            direct = None
        found = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        new = None if found.isEmpty() else _verified(found, chosen, sample, words)
        tried = tried.unionByName(found)
        linked = new is not None and not new.isEmpty()
        if linked:
            roots = components(roots.toDF("a", "b").unionByName(new))
        if not best:  # all pairs of different components that still met
            return documents, materialise(roots, "roots")
        rooted = rooted.drop("last")
        best = linked


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, the smallest key that its links reach, its own included.

    Equal texts link unless they have no words; a document without words (a null text too) links with nothing. A null key
    counts as larger than any other. Rows with equal keys are documents of their own. Other columns aren't read.
    """
    documents, roots = jaccard_nodes(docs, key, text, words)
    joined = documents.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.where("size > 0").groupBy("root").agg(F.min("id").alias("least"))
    return joined.join(least, "root", "left").select(
        F.col("id").alias(key),
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest key, of rows with the same key one; documents
    without words all stay. All columns, whatever their names."""
    documents, roots = jaccard_nodes(docs, key, text)
    joined = documents.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    identity = F.struct(F.col("id").isNull().alias("unknown"), F.coalesce("id", F.lit(0)).alias("id"), "tie")
    best = joined.where("size > 0").groupBy("root").agg(F.min(identity).alias("row")).select("row.*", F.lit(False).alias("every"))
    empty = joined.where("size = 0").select(identity.alias("row")).distinct().select("row.*", F.lit(True).alias("every"))
    return keep_rows(docs, best.unionByName(empty), key, text)
