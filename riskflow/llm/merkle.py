"""Merkle manifest of a dataset: hash trees over the rows of each group, stored in van Emde Boas layout.

The rows of a group, in order of their key, are the leaves of a binary tree; the groups' roots are the leaves of a tree on
top. A tree is cut into aligned subtrees of ``HEIGHT`` levels, one row each, whose nodes lie in one byte string: the upper
half of the levels first, then each subtree below it, both laid out the same way in turn. Addresses follow from depth and
index alone, whatever the block size of the storage. The roots of the subtrees are the leaves of the next level of
subtrees, until one is left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.positions import numbered
from riskflow.session import scratch_path

HEIGHT = 10
WIDTH = 32
ALONE, RIGHT, LEFT = 0, 1, 2
TOP = ""


@lru_cache(maxsize=64)
def _splits(height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By depth: depth of the root of the upper tree, its size, and the size of each tree below it."""
    upper, size, below = (np.zeros(height + 1, dtype=np.int64) for _ in range(3))

    def split(depth: int, levels: int) -> None:
        if levels < 2:
            return
        high = levels // 2
        low = levels - high
        upper[depth + high], size[depth + high], below[depth + high] = depth, (1 << high) - 1, (1 << low) - 1
        split(depth, high)
        split(depth + high, low)

    split(0, height + 1)
    return upper, size, below


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes ``index`` at ``depth`` in a tree of ``height`` (depths 0 to height)."""
    upper, size, below = _splits(height)
    found = np.zeros(np.shape(index), dtype=np.int64)
    index = np.asarray(index, dtype=np.int64)
    while depth:
        found += size[depth] + (index & size[depth]) * below[depth]
        index = index >> (depth - upper[depth])
        depth = int(upper[depth])
    return found


def block_height(leaves: int, total: int, height: int = HEIGHT) -> int:
    """Levels above the leaves of a block: all where the tree goes on, else as many as its leaves need."""
    return height if total > 1 << height else max(leaves - 1, 0).bit_length()


def build_block(leaves: Sequence[bytes], height: int) -> bytes:
    """All nodes above ``leaves``, in layout; a node is the hash of its children's hexadecimal digests, also of one alone."""
    nodes = np.zeros(((2 << height) - 1, WIDTH), dtype=np.uint8)
    level = list(leaves)
    for depth in range(height, -1, -1):
        nodes[address(height, depth, np.arange(len(level)))] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, WIDTH)
        if depth:
            level = [sha256(b"".join(level[i : i + 2]).hex().encode()).digest() for i in range(0, len(level), 2)]
    return nodes.tobytes()


def siblings(nodes: bytes, leaves: int, height: int) -> list[tuple[list[tuple[int, str]], str]]:
    """For each leaf of a block, its steps upwards (side of the sibling, its digest in hexadecimal) and its own digest."""
    hexed = nodes.hex()
    index = np.arange(leaves)
    places, sides = [], []
    count = leaves
    for depth in range(height, 0, -1):
        other = index ^ 1
        sides.append(np.where(other >= count, ALONE, np.where(other > index, RIGHT, LEFT)).tolist())
        places.append((address(height, depth, np.minimum(other, count - 1)) * 2 * WIDTH).tolist())
        index, count = index >> 1, (count + 1) >> 1
    own = (address(height, height, np.arange(leaves)) * 2 * WIDTH).tolist()
    found = []
    for i in range(leaves):
        steps = [(side[i], hexed[place[i] : place[i] + 2 * WIDTH] if side[i] else "") for side, place in zip(sides, places)]
        found.append((steps, hexed[own[i] : own[i] + 2 * WIDTH]))
    return found


def fold(leaf: str, steps: Sequence[tuple[int, str]]) -> str:
    """The root that ``leaf`` and the siblings on its way up give."""
    for side, digest in steps:
        pair = leaf + digest if side == RIGHT else digest + leaf
        leaf = sha256(pair.encode()).hexdigest()
    return leaf


def pack_steps(steps: Sequence[tuple[int, str]]) -> bytes:
    return b"".join(bytes([side]) + bytes.fromhex(digest or "00" * WIDTH) for side, digest in steps)


def unpack_steps(packed: bytes) -> list[tuple[int, str]]:
    size = WIDTH + 1
    cut = (packed[i : i + size] for i in range(0, len(packed), size))
    return [(c[0], c[1:].hex() if c[0] else "") for c in cut]


def field_digest(fields: Sequence[Column]) -> Column:
    """Hexadecimal SHA-256 of the fields behind one another: ``-`` for null, else byte count, ``:``, value."""
    shown = (f.cast("string") for f in fields)
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]
    return F.sha2(F.concat(*parts), 256)


_BLOCKS = "tree string, block bigint, leaves int, total bigint, nodes binary, root binary, keys array<bigint>, claims array<binary>"
_ARROW = pa.schema(
    [
        ("tree", pa.string()), ("block", pa.int64()), ("leaves", pa.int32()), ("total", pa.int64()), ("nodes", pa.binary()),
        ("root", pa.binary()), ("keys", pa.list_(pa.int64())), ("claims", pa.list_(pa.binary())),
    ]
)


def _blocks(rows: DataFrame, height: int) -> DataFrame:
    """One row for each aligned run of leaves; ``rows`` has tree, at (position), total, leaf, key, claim. A task holds one run."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, leaves, keys, claims = None, 0, [], [], []

        def close() -> pa.RecordBatch:
            levels = block_height(len(leaves), total, height)
            nodes = build_block(leaves, levels)
            row = {
                "tree": current[0], "block": current[1], "leaves": len(leaves), "total": total, "nodes": nodes,
                "root": nodes[:WIDTH], "keys": keys, "claims": claims,
            }
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("tree", "block", "total", "leaf", "key", "claim"))
            for tree, block, every, leaf, key, claim in zip(*columns, strict=True):
                if (tree, block) != current:
                    if current is not None:
                        yield close()
                    current, total, leaves, keys, claims = (tree, block), every, [], [], []
                leaves.append(leaf)
                keys.append(key)
                claims.append(claim)
        if current is not None:
            yield close()

    dealt = rows.withColumn("block", F.shiftright("at", height)).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    return dealt.mapInArrow(build, _BLOCKS)


@dataclass
class Manifest:
    """Levels of subtrees of the groups (``trees``) and of the tree over their roots (``top``), and the root of all."""

    path: str
    height: int
    trees: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Manifest:
        config = json.loads(spark.read.text(f"{path}/config").first()["value"])
        levels = {name: [spark.read.parquet(f"{path}/{name}-{i}") for i in range(config[name])] for name in ("trees", "top")}
        return cls(path, config["height"], levels["trees"], levels["top"], config["root"])

    def _down(self, levels: list[DataFrame], starts: DataFrame) -> DataFrame:
        """Steps above every subtree of the lowest level; ``starts`` has those above each tree's root."""
        above = starts
        for level in levels[:0:-1]:
            columns = ["tree", "block", "leaves", "total", "nodes"]
            above = starts.unionByName(self._joined(level, columns, above).mapInArrow(_spread_steps(self.height), _STEPS))
        return above

    def _joined(self, level: DataFrame, columns: list[str], above: DataFrame) -> DataFrame:
        """Subtrees with the steps above them; the one that ends its tree takes those above the tree's root."""
        return level.select(*columns, (F.col("total") <= 1 << self.height).alias("last")).join(above, ["tree", "block", "last"])

    def proofs(self) -> DataFrame:
        """One row per row of the table: key, leaf, subroot, root, proof_sha256, folded_root, verified.

        ``proof_sha256`` is the hash of all siblings from the leaf up; ``folded_root`` follows from them and the claimed leaf
        where the manifest was built with claims, else from the leaf itself; ``verified`` if it equals the root.
        """
        spark = self.trees[0].sparkSession
        start = spark.range(1).select(
            F.lit(TOP).alias("tree"), F.col("id").alias("block"), F.lit(True).alias("last"), F.lit(b"").alias("steps"),
            F.lit("").alias("subroot"),
        )
        columns = ["tree", "block", "leaves", "total", "nodes"]
        named = self._joined(self.top[0], [*columns, "names"], self._down(self.top, start))
        below = self._down(self.trees, named.mapInArrow(_spread_steps(self.height), _STEPS))
        return self._joined(self.trees[0], [*columns, "keys", "claims"], below).mapInArrow(
            _prove(self.height, self.root),
            "key bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
        )


_STEPS = "tree string, block bigint, last boolean, steps binary, subroot string"


def _spread_steps(height: int):
    """Blocks with the steps above them to one row for each of their leaves, with all steps above that.

    Leaves of the top tree, which have ``names``, become the roots of the trees so named.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = siblings(row["nodes"], row["leaves"], block_height(row["leaves"], row["total"], height))
                packed = [pack_steps(steps) + row["steps"] for steps, _ in found]
                children = row.get("names")
                first = row["block"] << height
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array(children or [row["tree"]] * len(found), pa.string()),
                        "block": pa.array([0] * len(found) if children else range(first, first + len(found)), pa.int64()),
                        "last": pa.array([bool(children)] * len(found), pa.bool_()),
                        "steps": pa.array(packed, pa.binary()),
                        "subroot": pa.array([leaf for _, leaf in found] if children else [row["subroot"]] * len(found), pa.string()),
                    }
                )

    return spread


def _prove(height: int, root: str | None):
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                above = unpack_steps(row["steps"])
                above_text = "".join(digest for _, digest in above)
                found = siblings(row["nodes"], row["leaves"], block_height(row["leaves"], row["total"], height))
                proofs, folded = [], []
                for (steps, leaf), claim in zip(found, row["claims"], strict=True):
                    proofs.append(sha256(("".join(digest for _, digest in steps) + above_text).encode()).hexdigest())
                    folded.append(fold(claim.hex() if claim else leaf, [*steps, *above]))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(row["keys"], pa.int64()),
                        "leaf": pa.array([leaf for _, leaf in found], pa.string()),
                        "subroot": pa.array([row["subroot"]] * len(found), pa.string()),
                        "root": pa.array([root] * len(found), pa.string()),
                        "proof_sha256": pa.array(proofs, pa.string()),
                        "folded_root": pa.array(folded, pa.string()),
                        "verified": pa.array([f == root for f in folded], pa.bool_()),
                    }
                )

    return prove


def _levels(rows: DataFrame, path: str, name: str, height: int) -> list[DataFrame]:
    """Write every level of subtrees over ``rows``; a level has 2**height times fewer rows than the one below."""
    spark, levels = rows.sparkSession, []
    while True:
        levels.append(_written(_blocks(rows, height), f"{path}/{name}-{len(levels)}"))
        rows = levels[-1].where(F.col("total") > 1 << height).select(
            "tree", F.col("block").alias("at"), F.shiftright(F.col("total") + ((1 << height) - 1), height).alias("total"),
            F.col("root").alias("leaf"), F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("binary").alias("claim"),
        )
        if rows.isEmpty():
            return levels


def _written(table: DataFrame, path: str) -> DataFrame:
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _roots(levels: list[DataFrame], height: int) -> DataFrame:
    done = [level.where(F.col("total") <= 1 << height).select("tree", "root") for level in levels]
    union = done[0]
    for more in done[1:]:
        union = union.unionByName(more)
    return union


def build_manifest(
    docs: DataFrame, fields: Sequence[str], key: str = "doc_id", group: str = "lang", claims: dict[str, Column] | None = None,
    path: str | None = None, height: int = HEIGHT,
) -> Manifest:
    """Write the manifest of ``docs`` to ``path`` (a new folder under the shared one by default).

    A leaf is the digest of ``fields``. ``claims`` gives other values of some fields, for the leaf that a later reader
    claims: its proofs fail unless they equal the stored ones. Leaves ascend by ``key`` (a bigint, null first, equal keys
    by their digest); a null group is one of its own and comes first. Repeated rows are leaves each. Other columns aren't
    read, nulls and texts of any length are digested whole. An empty table has no root and no proofs.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "manifest")
    leaf = field_digest([F.col(f"`{f}`") for f in fields])
    claim = F.lit(None).cast("string")
    if claims:
        changed = F.lit(False)
        for f, value in claims.items():
            changed = changed | ~value.eqNullSafe(F.col(f"`{f}`"))
        claim = F.when(changed, field_digest([claims.get(f, F.col(f"`{f}`")) for f in fields]))
    chosen = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("tree"),
        F.col(f"`{key}`").cast("bigint").alias("key"), F.unhex(leaf).alias("leaf"), F.unhex(claim).alias("claim"),
    )
    rows = numbered(chosen, "tree", [F.col("key").asc_nulls_first(), F.col("leaf")], "at", "total")
    trees = _levels(rows, path, "trees", height)
    subroots = _roots(trees, height).select(F.lit(TOP).alias("over"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    ranked = numbered(subroots, "over", [F.col("name")], "at", "total")
    above = ranked.select(
        F.lit(TOP).alias("tree"), "at", "total", "leaf", F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("binary").alias("claim")
    )
    tops = _levels(above, path, "over", height)
    names = ranked.groupBy(F.shiftright("at", height).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("pairs"))
    named = tops[0].join(names, "block").select(*tops[0].columns, F.transform("pairs", lambda p: p["name"]).alias("names"))
    top = [_written(table, f"{path}/top-{i}") for i, table in enumerate([named, *tops[1:]])]
    last = _roots(top, height).first()
    root = last["root"].hex() if last else None
    config = {"height": height, "trees": len(trees), "top": len(top), "root": root}
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(f"{path}/config")
    return Manifest(path, height, trees, top, root)
