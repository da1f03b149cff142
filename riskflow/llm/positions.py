"""Positions of rows within groups of any size: sorted ranges, counts a range, prefix sums over the ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from riskflow.llm.common import fresh
from riskflow.session import materialise


def numbered(table: DataFrame, group: str, order: Sequence[Column], name: str, total: str | None = None) -> DataFrame:
    """Append ``name``, the position from 0 of each row in its ``group`` (not null) under ``order``, and the rows of the group.

    Rows go to sorted ranges of (group, order, place in the input), so neither a large group nor many equal rows fill a
    task; a range numbers its rows, and the rows of earlier ranges of the group are added. Those sums have one row a
    range and group.
    """
    tie, part, local, before = fresh(table, "place", "range", "local", "before")
    every = total or fresh(table, "total")[0]
    keys = [F.col(group), *order, F.col(tie)]
    ranged = table.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            values = batch.column(group)
            new = np.ones(rows, dtype=bool)
            new[0] = values[0].as_py() != last
            new[1:] = pc.not_equal(values.slice(1), values.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            index = np.arange(rows)
            run = np.searchsorted(starts, index, side="right") - 1  # -1: goes on from the last batch
            numbers = np.where(run < 0, index + count, index - (starts[run] if len(starts) else 0))
            last, count = values[rows - 1].as_py(), int(numbers[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(rows, at), pa.int32()), pa.array(numbers, pa.int64())],
                names=[*batch.schema.names, part, local],
            )

    kept = ranged.drop(tie)
    schema = StructType([*kept.schema.fields, StructField(part, IntegerType()), StructField(local, LongType())])
    placed = materialise(kept.mapInArrow(number, schema), "numbered")
    counts = placed.groupBy(part, group).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(group).orderBy(part)
    sums = counts.select(
        part, group,
        (F.sum("rows").over(earlier) - F.col("rows")).alias(before),
        F.sum("rows").over(Window.partitionBy(group)).alias(every),
    )
    joined = placed.join(materialise(sums, "sums"), [part, group])
    columns = [F.col(f"`{c}`") for c in table.columns]
    found = joined.select(*columns, (F.col(local) + F.col(before)).alias(name), every)
    return found if total else found.drop(every)
