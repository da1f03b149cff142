"""File selection on any Hadoop file system (SRC-5, SRC-7)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def _status(spark: SparkSession, path: str):
    location, system = hadoop_path(spark, path)
    return system.getFileStatus(location) if system.exists(location) else None


def path_exists(spark: SparkSession, path: str) -> bool:
    return _status(spark, path) is not None


def require_directory(spark: SparkSession, path: str) -> None:
    status = _status(spark, path)
    if status is None:
        raise FileNotFoundError(f"Directory not found: {path}")
    if not status.isDirectory():
        raise NotADirectoryError(f"Path is not a directory: {path}")


def _endings(extension: str | Sequence[str] | None) -> tuple[str, ...]:
    """``csv``, ``.csv`` or ``*.csv``, or several of them, as lower-case name endings; all names without."""
    if extension is None:
        return ("",)
    wanted = [extension] if isinstance(extension, str) else list(extension)
    return tuple("." + e.lstrip("*").lstrip(".").lower() for e in wanted)


def _listing(spark: SparkSession, directory: str, extension: str | Sequence[str] | None, recursive: bool) -> Iterator[str]:
    """Paths of the matching files, one by one as the file system gives them; names of any kind, empty files too.

    What a write that has not ended keeps below ``_temporary`` is no file yet.
    """
    location, system = hadoop_path(spark, directory)
    found = system.listFiles(location, True) if recursive else system.listStatusIterator(location)
    endings = _endings(extension)
    while found.hasNext():
        status = found.next()
        path = status.getPath()
        if status.isFile() and path.getName().lower().endswith(endings) and "/_temporary/" not in path.toString():
            yield path.toString()


def list_files(
    spark: SparkSession, directory: str, extension: str | Sequence[str] | None = None, recursive: bool = False
) -> DataFrame:
    """(path) of the matching files, sorted; without ``recursive`` those of the folder itself only."""
    require_directory(spark, directory)
    found = sorted(_listing(spark, directory, extension, recursive))
    return spark.createDataFrame([(p,) for p in found], "path string").orderBy("path")


def file_count(spark: SparkSession, directory: str, extension: str = "parquet") -> int:
    """Number of files under a folder and its subfolders."""
    return sum(1 for _ in _listing(spark, directory, extension, True))


def has_files(spark: SparkSession, directory: str, extension: str) -> bool:
    """Whether the folder or a subfolder has such a file; the search ends at the first."""
    return path_exists(spark, directory) and next(_listing(spark, directory, extension, True), None) is not None
