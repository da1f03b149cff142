"""Seeded pseudo-random numbers that depend on the key alone.

``rand(seed)`` changes with the partitioning, and a retried task may then see other rows than the
first attempt. Hashing the key gives every row the same number in every plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 4294967296.0  # 2 ** 32


def _key_text(key: str | Column | list) -> list[Column]:
    parts = key if isinstance(key, (list, tuple)) else [key]
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return [F.coalesce(c.cast("string"), F.lit("")) for c in columns]


def hash_text(key: str | Column | list, seed: int) -> Column:
    """32 hex digits of md5 over ``seed|key``; sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *_key_text(key)))


def hash_bucket(key: str | Column | list, seed: int) -> Column:
    """Leading 32 bits of the hash as a non-negative bigint."""
    return F.conv(F.substring(hash_text(key, seed), 1, 8), 16, 10).cast("bigint")


def hash_fraction(key: str | Column | list, seed: int) -> Column:
    """Uniform double in [0, 1)."""
    return hash_bucket(key, seed).cast("double") / F.lit(_RANGE)
