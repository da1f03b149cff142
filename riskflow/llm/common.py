"""Small helpers: unused column names, Arrow batches by size, words and their hashes as numpy arrays."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def row_identity(key: str, text: str) -> list[Column]:
    """What tells a row from others: whether the key is null, the key, and a hash of the text."""
    known = F.col(f"`{key}`").cast("bigint")
    return [known.isNull(), F.coalesce(known, F.lit(0).cast("bigint")), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))]


def keep_rows(docs: DataFrame, kept: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose identity is in ``kept`` (unknown, id, tie, every; each identity once): all of them with
    ``every``, else one. One shuffle of the rows, which the choice of one reuses."""
    names = fresh(docs, "unknown_key", "known_key", "text_tie", "every_row", "row_number", "row_hash")
    marked = docs.select("*", *(c.alias(n) for c, n in zip(row_identity(key, text), names, strict=False)))
    right = kept.select(*(F.col(c).alias(n) for c, n in zip(("unknown", "id", "tie", "every"), names, strict=False)))
    joined = marked.join(right, names[:3]).withColumn(names[5], F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    window = Window.partitionBy(*names[:3]).orderBy(names[5])
    chosen = joined.withColumn(names[4], F.row_number().over(window)).where(F.col(names[3]) | (F.col(names[4]) == 1))
    return chosen.select(*(F.col(f"`{c}`") for c in docs.columns))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the binary ``column`` holds at most ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = byte_offsets(batch.column(column))[1:]
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, base + limit, side="right")), first + 1)
            yield batch.slice(first, last - first)
            first = last


def byte_offsets(column: pa.Array) -> np.ndarray:
    """Offsets of the values of a binary array from its first byte; nulls are empty."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array behind one another, and the offset of each value in them."""
    joined = b"".join(v for v in column.to_pylist() if v is not None)
    return np.frombuffer(joined, dtype=np.uint8), byte_offsets(column)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all of them."""
    with np.errstate(over="ignore"):
        x = values ^ (values >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    both = []
    for base in (_MULTIPLIER, inverse):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


def give_back() -> None:
    """Return what earlier tasks of this Python process left behind, its tables of powers and free memory, to the system.

    Spark hands a worker from operator to operator, and each would otherwise come on top of the peak of those before.
    """
    _powers.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def byte_codes(lower: bool) -> np.ndarray:
    """A 64-bit code for each byte; with ``lower`` A-Z share those of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER & _MASK))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {flag: byte_codes(flag) for flag in (False, True)}


class RollingHash:
    """64-bit polynomial hash of any run of bytes of one buffer, from prefix sums. Powers are kept for ``least`` bytes or more."""

    def __init__(self, data: np.ndarray, lower: bool = False, least: int = SLICE_BYTES) -> None:
        size = 1 << max(least.bit_length(), int(len(data)).bit_length())
        forward, self._back = _powers(size)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_CODES[lower][data] * forward[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * self._back[starts]

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from every position that has so many."""
        n = max(0, len(self._sums) - width)
        return (self._sums[width:] - self._sums[:n]) * self._back[:n]


_TAILS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each run of bytes: its length, then eight bytes at a time, each mixed with all before."""
    padded = np.concatenate((_LOWER[data] if lower else data, np.zeros(8, np.uint8)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    found = mix((ends - starts).astype(np.uint64) + np.uint64(_MULTIPLIER))
    live, at = np.arange(len(starts)), starts
    while len(live):
        rest = np.minimum(ends[live] - at, 8)
        block = np.ascontiguousarray(windows[at]).view(np.uint64).ravel() & _TAILS[rest]
        found[live] = mix(found[live] ^ block) + np.uint64(_MULTIPLIER)
        more = at + 8 < ends[live]
        live, at = live[more], at[more] + 8
    return found


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are not white space (0x20, 0x09-0x0D), and the first word
    of each value (one more at the end). Runs never cross from one value to the next."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the first word of each value."""
    starts, ends, first = word_bounds(data, offsets)
    return mix(RollingHash(data, lower).of(starts, ends)), first
