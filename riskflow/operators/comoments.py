"""Counts, means and co-moments of all pairs of columns in one pass, as blocks that can be merged (AGG-13..15).

A task turns its batches into matrices: with values ``X`` (missing as 0) and marks ``M`` of those present, all pairwise counts are
``M'M``, sums ``X'M`` and products ``X'X``. Blocks are merged by the formula for two parts, so no sum ever holds the square of a
large mean. The number of jobs doesn't depend on the number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.scalars import number
from riskflow.session import materialise

#: Blocks that one task merges.
FAN_IN = 16
_PARTS = ("n", "mean_a", "mean_b", "square_a", "square_b", "product")


@dataclass
class Comoments:
    """Six matrices, row a and column b over the rows where both are present: count, means of a and of b, sums of squared
    distances from them, and of their products."""

    n: np.ndarray
    mean_a: np.ndarray
    mean_b: np.ndarray
    square_a: np.ndarray
    square_b: np.ndarray
    product: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> Comoments:
        """From rows of values; NaN is missing."""
        here_a, here_b = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
        centre_a, centre_b = (_centre(x, m) for x, m in ((a, here_a), (b, here_b)))
        x, y = (np.where(m > 0, v - c, 0.0) for v, m, c in ((a, here_a, centre_a), (b, here_b, centre_b)))
        n = here_a.T @ here_b
        return cls._from_sums(n, x.T @ here_b, here_a.T @ y, (x * x).T @ here_b, here_a.T @ (y * y), x.T @ y, centre_a[:, None], centre_b[None, :])

    @classmethod
    def paired(cls, a: np.ndarray, b: np.ndarray) -> Comoments:
        """From rows of matrices: entry (i, j) of ``a`` beside entry (i, j) of ``b``."""
        here = ~(np.isnan(a) | np.isnan(b))
        n = here.sum(axis=0).astype(float)
        safe = np.maximum(n, 1)
        centre_a, centre_b = (np.where(here, v, 0.0).sum(axis=0) / safe for v in (a, b))
        x, y = np.where(here, a - centre_a, 0.0), np.where(here, b - centre_b, 0.0)
        return cls._from_sums(n, x.sum(0), y.sum(0), (x * x).sum(0), (y * y).sum(0), (x * y).sum(0), centre_a, centre_b)

    @classmethod
    def _from_sums(cls, n, sum_a, sum_b, sq_a, sq_b, prod, centre_a, centre_b) -> Comoments:
        safe = np.maximum(n, 1)
        shift_a, shift_b = sum_a / safe, sum_b / safe
        return cls(
            n, np.where(n > 0, centre_a + shift_a, 0.0), np.where(n > 0, centre_b + shift_b, 0.0),
            sq_a - sum_a * shift_a, sq_b - sum_b * shift_b, prod - sum_a * shift_b,
        )

    def merge(self, other: Comoments) -> Comoments:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        da, db = other.mean_a - self.mean_a, other.mean_b - self.mean_b
        both = self.n * share
        return Comoments(
            n, self.mean_a + da * share, self.mean_b + db * share,
            self.square_a + other.square_a + da * da * both, self.square_b + other.square_b + db * db * both,
            self.product + other.product + da * db * both,
        )

    def correlation(self) -> np.ndarray:
        """NaN where fewer than one row has both, or either is constant among those."""
        with np.errstate(invalid="ignore", divide="ignore"):
            below = np.sqrt(self.square_a) * np.sqrt(self.square_b)
            return np.where((self.square_a > _nothing(self.mean_a, self.n)) & (self.square_b > _nothing(self.mean_b, self.n)), self.product / below, np.nan)

    def pack(self) -> bytes:
        return np.stack([getattr(self, p) for p in _PARTS]).astype("<f8").tobytes()

    @classmethod
    def unpack(cls, packed: bytes, shape: tuple[int, int]) -> Comoments:
        return cls(*np.frombuffer(packed, "<f8").reshape(len(_PARTS), *shape))


def _centre(x: np.ndarray, here: np.ndarray) -> np.ndarray:
    return np.where(here > 0, x, 0.0).sum(axis=0) / np.maximum(here.sum(axis=0), 1)


def _nothing(mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What rounding alone leaves of the squares of a constant column."""
    return n * (np.abs(mean) * 4 * np.finfo(float).eps) ** 2


def _merged(batches: Iterator[pa.RecordBatch], shape: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for packed in batch.column("block").to_pylist():
            block = Comoments.unpack(packed, shape)
            total = block if total is None else total.merge(block)
    if total is not None:
        yield pa.RecordBatch.from_pydict({"block": pa.array([total.pack()], pa.binary())})


def _collected(blocks: DataFrame, shape: tuple[int, int]) -> Comoments:
    """All blocks in one, ``FAN_IN`` to a task, level by level; only the last few reach the driver."""
    blocks = materialise(blocks, "comoments")
    count = blocks.count()
    while count > FAN_IN:
        groups = math.ceil(count / FAN_IN)
        dealt = blocks.select("block", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("slot")).repartition(groups, "slot")
        blocks = materialise(dealt.select("block").mapInArrow(lambda b: _merged(b, shape), "block binary"), "comoments")
        count = blocks.count()
    total = None
    for row in blocks.collect():
        block = Comoments.unpack(row["block"], shape)
        total = block if total is None else total.merge(block)
    return total if total is not None else Comoments(*(np.zeros(shape) for _ in _PARTS))


def comoments(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None, values: dict[str, Column] | None = None) -> Comoments:
    """Of every column of ``left`` with every one of ``right`` (``left`` itself by default), in one scan.

    A task and the driver hold six matrices of these columns; rows pass through in batches.
    """
    right = list(left) if right is None else list(right)
    names = list(dict.fromkeys([*left, *right]))
    values = values or {c: number(df.schema[c]) for c in names}
    chosen = df.select(*(values[c].cast("double").alias(f"c{i}") for i, c in enumerate(names)))
    a, b = ([names.index(c) for c in side] for side in (left, right))
    shape = (len(left), len(right))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            block = Comoments.of(matrix[:, a], matrix[:, b])
            total = block if total is None else total.merge(block)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([total.pack()], pa.binary())})

    return _collected(chosen.mapInArrow(scan, "block binary"), shape)


def paired_comoments(df: DataFrame, column: str, size: int) -> Comoments:
    """Of entry (i, j) with entry (j, i) of the square matrices that ``column`` (array of ``size`` arrays of ``size``) holds."""
    shape = (size, size)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat = part.column(0).flatten().flatten().to_numpy(zero_copy_only=False).astype(float)
                cube = flat.reshape(part.num_rows, size, size)
                block = Comoments.paired(cube, cube.transpose(0, 2, 1))
                total = block if total is None else total.merge(block)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([total.pack()], pa.binary())})

    return _collected(df.select(column).mapInArrow(scan, "block binary"), shape)
