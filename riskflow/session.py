"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local property that names the folder of the enclosing scope.
SCOPE = "riskflow.scratch.scope"
#: Rows to a file of a table that is dealt out for training.
SPREAD_ROWS = 100_000


def build_session(cores: str | int = "*", app: str = "riskflow", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, use the session it provides."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a machine-local folder
    would vanish with its executor, so a missing setting is an error there.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):  # local-cluster has executors of its own
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="riskflow-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder, or under that of the enclosing ``scratch_scope``."""
    scope = spark.sparkContext.getLocalProperty(SCOPE)
    root = checkpoint_root(spark).rstrip("/")
    return "/".join([root, *([scope] if scope else []), f"{label}-{uuid.uuid4().hex}"])


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Tables that are written to scratch paths inside the scope, also by threads that inherit it, are deleted at its end.

    For work whose result is a number or a stored model; a DataFrame that reads such a table can't outlive it.
    """
    context = spark.sparkContext
    outer = context.getLocalProperty(SCOPE)
    scope = "/".join([*([outer] if outer else []), f"scope-{uuid.uuid4().hex}"])
    context.setLocalProperty(SCOPE, scope)
    try:
        yield scope
    finally:
        context.setLocalProperty(SCOPE, outer)
        discard(spark, f"{checkpoint_root(spark).rstrip('/')}/{scope}")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that was drawn with ``scratch_path`` or belongs to a scope."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, label: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; ``path`` is one drawn before, say outside a scope.

    Cuts the lineage: later jobs neither recompute nor re-order it, and a lost executor takes nothing
    with it. The copy is columnar, so later scans prune it, and its size and row count are known.
    """
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(table: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``table``, by a hash of what they hold, in as many sorted partitions as its counted rows need.

    A scan packs files by their packed size, so a task's rows would grow with how well they pack; here they do not. ``by`` are the
    columns that deal, all by default.
    """
    parts = max(1, math.ceil(table.count() / SPREAD_ROWS))
    by = list(by or table.columns)
    rows = table.repartition(parts, F.xxhash64(*(F.col(f"`{c}`") for c in by)))
    # Within a partition, too, the order of rows must not come from the input.
    return rows.sortWithinPartitions(*(F.col(f"`{c}`") for c in dict.fromkeys([*by, *table.columns])))


def spread(table: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Write ``table`` out again, its rows ``dealt``, one file a partition.

    For tables that are read many times by costly work, such as training. The layout follows from the rows, not from
    the cores or the files that they came from, and so does what is trained on it.
    """
    return materialise(dealt(table, by), "spread")
