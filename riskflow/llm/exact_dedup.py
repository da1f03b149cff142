"""Exact dedup with a cuckoo-filter index over the digests of normalised texts.

Every task keeps an index of the digests it has seen: a cuckoo filter answers "new" without touching a key, and
what it takes for known is verified against the digests stored in the key's home bucket. Tasks over the input
hand on one row per digest, so a text copied a million times is a few rows after the first shuffle; tasks over
digests do the same again and give the row that stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.llm.common import fresh, keep_rows, row_identity
from riskflow.session import materialise

SPACES = b" \t\n\x0b\x0c\r"
SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Keys (bytes of an even distribution, 16 at least) with a value each; insertion, deletion, look-up.

    ``filter`` holds 16-bit fingerprints, ``SLOTS`` to a bucket; a key's fingerprint is in one of two buckets, and
    either follows from the other and the fingerprint; keys that share both share a slot. ``content`` holds the keys themselves by home bucket. When
    an insertion finds no slot after ``MAX_KICKS`` moves, the filter is built anew with twice the buckets from the
    stored keys.
    """

    def __init__(self, buckets: int = 64) -> None:
        self._size = 1 << max(0, buckets - 1).bit_length()
        self._count = 0
        self._clear()

    def _clear(self) -> None:
        self._filter: list[list[int]] = [[] for _ in range(self._size)]
        self._content: list[list[list]] = [[] for _ in range(self._size)]

    def __len__(self) -> int:
        return self._count

    @property
    def buckets(self) -> int:
        return self._size

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        home = int.from_bytes(key[2:10], "little") & (self._size - 1)
        return mark, home, self._other(home, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self._size - 1))

    def _entry(self, key: bytes) -> list | None:
        mark, home, other = self._places(key)
        if mark in self._filter[home] or mark in self._filter[other]:
            for entry in self._content[home]:
                if entry[0] == key:
                    return entry
        return None

    def get(self, key: bytes):
        entry = self._entry(key)
        return None if entry is None else entry[1]

    def __contains__(self, key: bytes) -> bool:
        return self._entry(key) is not None

    def insert(self, key: bytes, value=True) -> None:
        """Store ``key``; one that is there gets the new value."""
        entry = self._entry(key)
        if entry is not None:
            entry[1] = value
            return
        self._content[self._places(key)[1]].append([key, value])
        self._count += 1
        if not self._place(key):
            self._resize()

    def delete(self, key: bytes) -> bool:
        """Remove ``key``; False if it isn't there. Only verified keys leave the filter."""
        entry = self._entry(key)
        if entry is None:
            return False
        mark, home, other = self._places(key)
        self._content[home].remove(entry)
        if not any(self._places(k)[0] == mark for at in {home, other} for k, _ in self._content[at]):
            self._filter[home if mark in self._filter[home] else other].remove(mark)
        self._count -= 1
        return True

    def items(self) -> Iterator[tuple]:
        return ((k, v) for bucket in self._content for k, v in bucket)

    def _place(self, key: bytes) -> bool:
        mark, home, other = self._places(key)
        if mark in self._filter[home] or mark in self._filter[other]:
            return True
        for bucket in (home, other):
            if len(self._filter[bucket]) < SLOTS:
                self._filter[bucket].append(mark)
                return True
        bucket = other
        for kick in range(MAX_KICKS):
            slots = self._filter[bucket]
            slots[kick % SLOTS], mark = mark, slots[kick % SLOTS]
            bucket = self._other(bucket, mark)
            if len(self._filter[bucket]) < SLOTS:
                self._filter[bucket].append(mark)
                return True
        return False

    def _resize(self) -> None:
        stored = list(self.items())
        while True:
            self._size *= 2
            self._clear()
            for key, value in stored:
                self._content[self._places(key)[1]].append([key, value])
            if all(self._place(key) for key, _ in stored):
                return


def digest(text: bytes | None) -> bytes:
    """SHA-256 of the UTF-8 text without white space (0x20, 0x09-0x0D); null counts as empty."""
    return hashlib.sha256((text or b"").translate(None, SPACES)).digest()


def _best(old: tuple | None, new: tuple) -> tuple:
    """Of (characters, no id, id, row, count): most characters, then smallest id, null last, then first row."""
    if old is None:
        return new
    count = old[4] + new[4]
    ahead = (-new[0], new[1], new[2], new[3]) < (-old[0], old[1], old[2], old[3])
    return (*(new if ahead else old)[:4], count)


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest of the task's rows."""
    index = CuckooIndex()
    schema = None
    for batch in batches:
        schema = batch.schema
        names = ("digest", "characters", "id", "row", "copies")
        for key, n, doc, row, copies in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            index.insert(key, _best(index.get(key), (n, doc is None, doc or 0, row, copies)))
    if schema is None:
        return
    kept = list(index.items())
    for at in range(0, len(kept), 10_000):
        part = kept[at : at + 10_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in part], pa.binary()),
                pa.array([v[0] for _, v in part], pa.int64()),
                pa.array([None if v[1] else v[2] for _, v in part], pa.int64()),
                pa.array([v[3] for _, v in part], pa.int64()),
                pa.array([v[4] for _, v in part], pa.int64()),
            ],
            names=["digest", "characters", "id", "row", "copies"],
        )


_STATE = "digest binary, characters bigint, id bigint, row bigint, copies bigint"


def with_digests(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Append the digest of each text."""
    names = [*docs.columns, name]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pa.array([digest(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], digests], names=names)

    (raw,) = fresh(docs, "raw")
    wide = docs.select("*", F.col(f"`{text}`").cast("binary").alias(raw))
    return wide.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def _digested(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The narrow table that the rest works on: identity, number of code points, digest and row number."""
    names = ("unknown", "id", "tie")
    narrow = docs.select(
        *(c.alias(n) for c, n in zip(row_identity(key, text), names, strict=True)),
        F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).cast("bigint").alias("characters"),
        F.col(f"`{text}`").alias("text"),
    )
    digested = with_digests(narrow, "text", "digest").select(
        F.when(~F.col("unknown"), F.col("id")).alias("id"), "tie", "characters", "digest",
        F.monotonically_increasing_id().alias("row"), F.lit(1).cast("bigint").alias("copies"),
    )
    return materialise(digested, "digests")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, digest.

    Texts are equal when their digests are. The row with the most code points stays, then the smallest key; a null
    key comes last, a null text is empty. Of rows with the same key and length exactly one is ``kept``. An empty
    table gives no rows. Other columns are not read, so their names don't matter.
    """
    return _judged(_digested(docs, key, text)).select(F.col("id").alias(key), "keep_id", "group_size", "kept", "digest")


def _judged(rows: DataFrame) -> DataFrame:
    partial = rows.select("digest", "characters", "id", "row", "copies").mapInArrow(_winners, _STATE)
    stays = partial.repartition("digest").mapInArrow(_winners, _STATE).select(
        "digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("copies").alias("group_size")
    )
    return rows.join(stays, "digest").withColumn("kept", F.col("row") == F.col("keep_row"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` would not keep; all columns, whatever their names."""
    kept = _judged(_digested(docs, key, text)).where("kept").select(
        F.col("id").isNull().alias("unknown"), F.coalesce("id", F.lit(0)).alias("id"), "tie", F.lit(False).alias("every")
    )
    return keep_rows(docs, kept, key, text)


def apply_changes(live: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The live digests after ``removed`` have gone and ``added`` have come, one row each; columns: digest.

    Each bucket of digests is one task's index; a digest that is both added and removed stays. Null digests are
    left out.
    """

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for key, what in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if what == 1:
                    index.delete(key)
                else:
                    index.insert(key)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in index.items()], pa.binary())], names=["digest"])

    sides = [df.select("digest", F.lit(i).alias("step")).distinct() for i, df in enumerate((live, removed, added))]
    every = sides[0].unionByName(sides[1]).unionByName(sides[2]).where("digest IS NOT NULL")
    return every.repartition("digest").sortWithinPartitions("step").mapInArrow(change, "digest binary")
