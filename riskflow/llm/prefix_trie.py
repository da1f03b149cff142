"""Prefix tries of conversations as burst tries: heads over containers of suffixes.

A conversation is a sequence of turn ids (digests of role and text). Equal sequences are one member with a count. A
container holds all sequences that share a prefix. While it holds more than ``CONTAINER`` turns it bursts: what all its
sequences share becomes a head, a chain of nodes, and the sequences go to new containers by their next turn id. What is
left is sorted, container by container, and swept into nodes with a stack. At last the heads add up, level by level,
what lies below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.session import materialise

CONTAINER = 20_000
ID_BYTES = 16
CHUNK = 1 << 16
NO_ENDS = sha256(b"").hexdigest()
ROOT = b"\0" * ID_BYTES


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, ID_BYTES)


def turn_id(role: Column, text: Column) -> Column:
    size = F.octet_length(role).cast("string")
    return _digest(F.concat(size, F.lit(":"), role, text))


def count_words(text: Column) -> Column:
    """Runs of characters that are not white space (0x20, 0x09-0x0D)."""
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))


_TURN = "array<struct<id:binary,words:int>>"


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): the turns of each conversation as (id, words), by turn (null first), role and text.

    A null role or text is empty; rows without a conversation are in none and left out. Repeated rows are turns like any
    other. A task holds one conversation's turns at a time, about 50 bytes each.
    """
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    chosen = conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("bigint").alias("conv"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
            F.substring(said, 1, 64).alias("start"), turn_id(F.coalesce(F.col(f"`{role}`"), F.lit("")), said).alias("id"),
            count_words(said).alias("words"),
        ).alias("turn"),
    )
    return chosen.groupBy("conv").agg(
        F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns")
    )


def with_shared_start(found: DataFrame, group: int = 20, modulus: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % ``group``, as many as there are;
    h is crc32 of the decimal c modulo ``modulus``."""
    found = materialise(found, "sequences")
    base = F.col("conv") - F.col("conv") % group
    heads = found.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, modulus - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(modulus)).cast("int")
    joined = found.withColumn("base", base).join(heads, "base", "left").withColumn("h", h)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    none = F.array().cast(_TURN)
    start = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))).otherwise(none)
    return joined.select("conv", F.concat(start, F.coalesce(rest, none)).alias("turns"))


def listed_digests(members: DataFrame, group: str, number: str) -> DataFrame:
    """(group, smallest, count, digest): SHA-256 of each group's numbers, ascending, decimal, comma-joined.

    Ranges of sorted rows are written out as pieces of text; a digest reads its group's pieces in order and keeps its
    state only. So a large group is sorted by many tasks and hashed as a stream.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, numbers, size = None, [], 0
        done: list[dict] = []

        def close() -> None:
            done.append({"group": current, "first": numbers[0], "count": len(numbers), "piece": ",".join(map(str, numbers))})

        for batch in batches:
            for value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if numbers and (value != current or size > CHUNK):
                    close()
                    numbers, size = [], 0
                current = value
                numbers.append(n)
                size += 12
            if done:
                yield pa.RecordBatch.from_pylist(done, _PIECES)
                done = []
        if numbers:
            close()
            yield pa.RecordBatch.from_pylist(done, _PIECES)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, count, state = None, None, 0, sha256()
        done: list[dict] = []

        def close() -> None:
            done.append({"group": current, "smallest": first, "count": count, "digest": state.hexdigest()})

        for batch in batches:
            for row in batch.to_pylist():
                if count and row["group"] == current:
                    state.update(b",")
                else:
                    if count:
                        close()
                    current, first, count, state = row["group"], row["first"], 0, sha256()
                state.update(row["piece"].encode())
                count += row["count"]
            if done:
                yield pa.RecordBatch.from_pylist(done, _DIGESTS)
                done = []
        if count:
            close()
            yield pa.RecordBatch.from_pylist(done, _DIGESTS)

    ordered = members.select(F.col(group).alias("group"), F.col(number).alias("n")).repartitionByRange("group", "n").sortWithinPartitions("group", "n")
    pieces = ordered.mapInArrow(cut, "`group` binary, first bigint, count bigint, piece string")
    return pieces.repartition("group").sortWithinPartitions("group", "first").mapInArrow(
        digest, "`group` binary, smallest bigint, count bigint, digest string"
    )


_PIECES = pa.schema([("group", pa.binary()), ("first", pa.int64()), ("count", pa.int64()), ("piece", pa.string())])
_DIGESTS = pa.schema([("group", pa.binary()), ("smallest", pa.int64()), ("count", pa.int64()), ("digest", pa.string())])


def members_of(found: DataFrame) -> DataFrame:
    """(conv, n, ends, ids, words): each distinct sequence once, with its smallest conversation, their number, and the digest
    of their list."""
    keyed = materialise(
        found.select(
            "conv", F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words")
        ).withColumn("whole", _digest(F.concat_ws("", F.transform("ids", lambda i: F.hex(i))))),
        "sequences",
    )
    listed = materialise(listed_digests(keyed.select("whole", "conv"), "whole", "conv"), "members")
    return keyed.join(listed.select(F.col("smallest").alias("conv"), F.col("count").alias("n"), F.col("digest").alias("ends")), "conv").select(
        "conv", "n", "ends", "ids", "words"
    )


_NODES = (
    "container binary, top boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
_NODE_COLUMNS = [c.split()[0] for c in _NODES.split(", ")]
_ARROW = pa.schema(
    [
        ("container", pa.binary()), ("top", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ]
)


class _Node:
    __slots__ = ("depth", "words", "conv", "n", "children", "leaves", "saved", "ends", "parent")

    def __init__(self, depth: int, words: int, parent: _Node | None) -> None:
        self.depth, self.words, self.parent = depth, words, parent
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, NO_ENDS


def sweep(rows: Iterator[tuple[int, int, str, list[bytes], list[int]]], depth: int) -> list[_Node]:
    """Nodes from ``depth`` down over sequences in order of their ids, which share their first ``depth`` turns.

    Two neighbours share the path from the top to where they part; what the first has below that is complete.
    """
    done: list[_Node] = []
    path: list[_Node] = []
    last: list[bytes] = []

    def close() -> None:
        node = path.pop()
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.words
        if path:
            above = path[-1]
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
            above.n, above.children = above.n + node.n, above.children + 1
            above.leaves, above.saved = above.leaves + node.leaves, above.saved + node.saved
        done.append(node)

    for conv, n, ends, ids, words in rows:
        same = depth
        while same < len(ids) and same < len(last) and ids[same] == last[same]:
            same += 1
        while path and path[-1].depth > same:
            close()
        if not path:
            path.append(_Node(depth, words[depth - 1] if depth else 0, None))
        for at in range(path[-1].depth, len(ids)):
            path.append(_Node(at + 1, words[at], path[-1]))
        node = path[-1]
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.n, node.ends, last = node.n + n, ends, ids
    while path:
        close()
    return done


def _sweep_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, depth, rows = None, 0, []

    def close() -> list[dict]:
        return [
            {
                "container": current, "top": node.parent is None, "conv_id": node.conv, "depth": node.depth,
                "parent_conv_id": node.parent.conv if node.parent else None, "n_convs": node.n, "n_children": node.children,
                "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.ends,
            }
            for node in sweep(iter(rows), depth)
        ]

    done: list[dict] = []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("container", "depth", "conv", "n", "ends", "ids", "words"))
        for container, at, *row in zip(*columns, strict=True):
            if container != current:
                if rows:
                    done += close()
                    if len(done) > 5000:
                        yield pa.RecordBatch.from_pylist(done, _ARROW)
                        done = []
                current, depth, rows = container, at, []
            rows.append(row)
    if rows:
        done += close()
    yield pa.RecordBatch.from_pylist(done, _ARROW)


def _shared(low: Column, high: Column) -> Column:
    """Length of the common start of two arrays."""
    agree = F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.when(F.array_position(agree, False) > 0, F.array_position(agree, False) - 1).otherwise(F.size(low)).cast("int")


def burst(members: DataFrame, limit: int = CONTAINER) -> tuple[DataFrame, list[DataFrame]]:
    """All sequences in containers of at most ``limit`` turns (or one sequence), and the heads of each round.

    A container is (container, depth): its sequences share their first ``depth`` turns. A head is (container, depth, end,
    words, ends_n, ends_conv, ends): a chain of nodes from ``depth`` to ``end``, the words of its turns, and the sequence
    that ends there. Containers at ``child`` of the end are its children.
    """
    start = members.select(F.lit(ROOT).alias("container"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), "conv", "n", "ends", "ids", "words")
    open_, settled, heads = materialise(start, "trie"), [], []
    while True:
        kinds = materialise(
            open_.groupBy("container", "parent", "depth").agg(
                F.count(F.lit(1)).alias("rows"), F.sum(F.size("ids") - F.col("depth") + 1).alias("turns"),
                F.min("ids").alias("low"), F.max("ids").alias("high"),
            ).where((F.col("rows") > 1) & (F.col("turns") > limit))
            .select("container", "parent", "depth", _shared(F.col("low"), F.col("high")).alias("end"), F.slice("low", 1, _shared(F.col("low"), F.col("high"))).alias("prefix")),
            "trie",
        )
        if kinds.isEmpty():
            settled.append(open_)
            break
        large = kinds.select("container", "end")
        settled.append(open_.join(large, "container", "left_anti"))
        inside = materialise(open_.join(large, "container"), "trie")
        # The words of the shared turns are those of any of the sequences.
        chains = inside.groupBy("container").agg(F.min(F.slice("words", 1, F.col("end"))).alias("words"))
        ended = inside.where(F.size("ids") == F.col("end")).select("container", F.col("conv").alias("end_conv"), F.col("n").alias("end_n"), "ends")
        heads.append(
            materialise(kinds.drop("prefix").join(chains, "container").join(ended, "container", "left"), "trie")
        )
        deeper = inside.where(F.size("ids") > F.col("end")).select(
            _digest(F.col("container"), F.get("ids", F.col("end"))).alias("container"), F.col("container").alias("parent"),
            (F.col("end") + 1).alias("depth"), "conv", "n", "ends", "ids", "words",
        )
        open_ = materialise(deeper, "trie")
    union = settled[0]
    for more in settled[1:]:
        union = union.unionByName(more)
    return union, heads


def trie_nodes(found: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """One row per node of the trie over ``found`` (conv, turns), the root included: conv_id (the smallest conversation that
    starts with it), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation without turns is at the root. No conversations give no rows. Conversations must be distinct.
    """
    settled, heads = burst(members_of(found), limit)
    settled = materialise(settled, "trie")
    swept = settled.repartition("container").sortWithinPartitions("container", "ids").mapInArrow(_sweep_containers, _NODES)
    swept = materialise(swept, "trie")
    if not heads:
        return swept.drop("container", "top")
    links = settled.select("container", "parent").distinct()
    tops = materialise(swept.where("top").join(links, "container"), "trie")
    below = tops.select("parent", "conv_id", "n_convs", "n_leaves", "saved_tokens")
    parts = [swept.where(~F.col("top")).drop("container", "top")]
    summed: list[DataFrame] = []
    for head in heads[::-1]:
        sums = below.groupBy("parent").agg(
            F.min("conv_id").alias("low"), F.sum("n_convs").alias("below_n"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("below_saved"), F.count(F.lit(1)).alias("n_children"),
        ).withColumnRenamed("parent", "container")
        joined = head.join(sums, "container").withColumn("conv_id", F.least("low", "end_conv")).withColumn("n_convs", F.col("below_n") + F.coalesce("end_n", F.lit(0)))
        # Where words count double: a chain node's own share is its turn's words, times all but one of its members.
        own = F.aggregate(F.slice("words", F.greatest("depth", F.lit(1)), F.size("words")), F.lit(0).cast("bigint"), lambda s, w: s + w)
        full = materialise(joined.withColumn("saved_tokens", F.col("below_saved") + (F.col("n_convs") - 1) * own), "trie")
        summed.append(full)
        below = tops.select(*below.columns).unionByName(full.select(*below.columns))
    every = summed[0]
    for more in summed[1:]:
        every = every.unionByName(more)
    above = every.select(F.col("container").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parts.append(tops.drop("parent_conv_id").join(above, "parent").drop("container", "parent", "top"))
    chain = every.join(above, "parent", "left").select("*", F.explode(F.sequence("depth", "end")).alias("at"))
    upto = F.aggregate(F.slice("words", F.greatest("at", F.lit(1)), F.size("words")), F.lit(0).cast("bigint"), lambda s, w: s + w)
    last = F.col("at") == F.col("end")
    parts.append(
        chain.select(
            "conv_id", F.col("at").cast("bigint").alias("depth"),
            F.when(F.col("at") > F.col("depth"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
            "n_convs", F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"), "n_leaves",
            (F.col("below_saved") + (F.col("n_convs") - 1) * upto).alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    return union
