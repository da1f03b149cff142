"""Tables that are whole or absent: staged writes, a rename, and a manifest that is written last (SNK-3, SNK-6, SNK-7)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from riskflow.sources.files import file_count, hadoop_path, path_exists

MANIFEST = "_manifest.json"
STAGED, REPLACED = "_staged-", "_replaced-"


def read_manifest(spark: SparkSession, directory: str) -> dict[str, Any] | None:
    """What the table's manifest says: rows, files and columns; None where no write has ended."""
    path, system = hadoop_path(spark, f"{directory}/{MANIFEST}")
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def is_complete(spark: SparkSession, directory: str) -> bool:
    """Whether a committed write made this folder and all of its files are there."""
    manifest = read_manifest(spark, directory)
    return manifest is not None and file_count(spark, directory) >= manifest["files"]


def commit_table(spark: SparkSession, directory: str, write: Callable[[str], None], rows: int | None = None) -> dict[str, Any]:
    """Let ``write(folder)`` write Parquet to a staged folder beside ``directory``, then put it in its place.

    A reader sees the old table or the new one. A run that breaks before the rename leaves the old table as it was; one that
    breaks between rename and manifest leaves a table that is not complete, so the next run writes it again. Where a rename is
    a copy, as in object stores, the manifest still comes last. What broken runs left staged is removed by the next.
    """
    parent, name = directory.rstrip("/").rsplit("/", 1)
    staged, replaced = (f"{parent}/{mark}{name}-{uuid.uuid4().hex}" for mark in (STAGED, REPLACED))
    discard_staged(spark, directory)
    write(staged)
    written = spark.read.parquet(staged)
    manifest = {
        "rows": written.count() if rows is None else rows,  # a count reads the footers of the files alone
        "files": file_count(spark, staged),
        "columns": [[f.name, f.dataType.simpleString()] for f in written.schema],
    }
    target, system = hadoop_path(spark, directory)
    aside = hadoop_path(spark, replaced)[0]
    if system.exists(target) and not system.rename(target, aside):
        raise OSError(f"{directory} can't be moved away")
    system.mkdirs(target.getParent())
    if not system.rename(hadoop_path(spark, staged)[0], target):
        raise OSError(f"{staged} can't be renamed to {directory}")
    stream = system.create(hadoop_path(spark, f"{directory}/{MANIFEST}")[0], True)
    try:
        stream.write(json.dumps(manifest).encode())
    finally:
        stream.close()
    system.delete(aside, True)
    return manifest


def commit_parquet(df: DataFrame, directory: str, compression: str = "snappy", **options: Any) -> dict[str, Any]:
    """``write_parquet`` under the protocol."""
    from riskflow.sources.tables import write_parquet

    return commit_table(df.sparkSession, directory, lambda folder: write_parquet(df, folder, compression=compression, **options))


def discard_staged(spark: SparkSession, directory: str) -> int:
    """Remove what broken writes of this table left beside it; the number of folders."""
    parent, name = directory.rstrip("/").rsplit("/", 1)
    if not path_exists(spark, parent):
        return 0
    path, system = hadoop_path(spark, parent)
    found, listing = [], system.listStatusIterator(path)
    while listing.hasNext():
        status = listing.next()
        if status.isDirectory() and status.getPath().getName().startswith((f"{STAGED}{name}-", f"{REPLACED}{name}-")):
            found.append(status.getPath())
    for stale in found:
        system.delete(stale, True)
    return len(found)
