"""Parquet files ``chunk_%06d.parquet`` of exactly so many rows, in order (SNK-1)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.config import COMPRESSION
from riskflow.session import materialise
from riskflow.sources.files import hadoop_path

#: ``monotonically_increasing_id`` holds the partition above this bit and the row within it below.
_ROW_BITS = 33


def with_positions(df: DataFrame, name: str, order: Sequence[str] = ()) -> DataFrame:
    """A written copy of ``df`` with ``name``, the position of each row from 0: by ``order``, else as the partitions hold them.

    Rows are counted by partition; the counts, one a partition, are summed up and joined back, so no row but the sorted ones
    moves and none waits for another.
    """
    if order:
        keys = [F.col(c).asc_nulls_first() for c in order]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialise(df.withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_place", _ROW_BITS)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = placed.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_part bigint, _before bigint")
    inside = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = placed.withColumn("_part", part).join(offsets, "_part")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + inside).alias(name))


def write_chunks(df: DataFrame, directory: str, rows: int, order: Sequence[str] = (), compression: str = COMPRESSION) -> int:
    """Write ``df`` as files of exactly ``rows`` rows, the last one of what is left, and return their number.

    File n holds the rows at positions ``n * rows`` and on, in order. A chunk is one task's work, so ``rows`` is what a task
    holds at most, and files are named after the write, one rename each. No rows: one file without rows.
    """
    if rows < 1:
        raise ValueError("rows must be at least 1")
    spark = df.sparkSession
    numbered = with_positions(df, "_position", order)
    chunk = (F.col("_position") / F.lit(rows)).cast("bigint") if rows > 1 else F.col("_position")
    dealt = numbered.withColumn("_chunk", F.floor(chunk)).repartition("_chunk").sortWithinPartitions("_chunk", "_position")
    names = [F.col(f"`{c}`") for c in df.columns]
    dealt.select(*names, "_chunk").write.option("compression", compression).partitionBy("_chunk").parquet(directory)
    root, system = hadoop_path(spark, directory)
    found, listing = 0, system.listStatusIterator(root)
    folders = []
    while listing.hasNext():
        status = listing.next()
        if status.getPath().getName().startswith("_chunk="):
            folders.append(status.getPath())
    for folder in folders:
        number = int(folder.getName().split("=")[1])
        files = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().endswith(".parquet")]
        if len(files) != 1:
            raise OSError(f"{folder.toString()} holds {len(files)} files")
        system.rename(files[0], hadoop_path(spark, f"{directory}/chunk_{number:06d}.parquet")[0])
        system.delete(folder, True)
        found += 1
    if not found:
        df.limit(0).coalesce(1).write.mode("overwrite").option("compression", compression).parquet(directory)
    return found
