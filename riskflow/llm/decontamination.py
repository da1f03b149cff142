"""Decontamination by winnowing, with DataFrame functions only.

Of every ``GRAMS`` consecutive k-grams of a text the one with the least hash is kept, so any two texts that share
``WINDOW`` consecutive words share a kept hash. Kept hashes of documents are looked up among those of the benchmark; around each
hit the windows of words that hold it are compared, by SHA-256, with the benchmark's windows, so a hit extends over every
shared window and over no other word. Benchmark items shorter than a window are one window each; documents are searched
for those by all runs of as many words, where the benchmark has such items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import fresh, row_identity
from riskflow.session import materialise

WINDOW = 10
K = 5
GRAMS = WINDOW - K + 1
#: Low bits of a k-gram's hash that hold its position while minima are taken; at least GRAMS positions differ in them.
PLACES = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IDENTITY = ["unknown", "id", "tie"]


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of letters, digits and characters beyond ASCII; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _GAP), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upto(last: Column) -> Column:
    """0 .. last, nothing where last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _mark(at: Column, length: int, hash_: Column) -> Column:
    return F.struct(at.alias("at"), F.lit(length).alias("length"), hash_.alias("mark"))


def winnowed(hashes: Column) -> Column:
    """Kept k-grams of a text's word hashes: (at, length of the windows that they stand for, mark)."""

    def of_grams(grams: Column) -> Column:
        # Equal hashes differ in their position's low bits here; the mark leaves those bits out.
        least = F.transform(
            _upto(F.size(grams) - GRAMS),
            lambda j: j + F.pmod(F.array_min(F.slice(grams, j + 1, GRAMS)) - j, F.lit(PLACES)).cast("int"),
        )
        return F.transform(
            F.array_distinct(least), lambda p: _mark(p, WINDOW, F.get(grams, p).bitwiseAND(F.lit(-PLACES).cast("bigint")))
        )

    def grams(known: Column) -> Column:
        return F.transform(
            _upto(F.size(known) - K),
            lambda i: F.xxhash64(F.slice(known, i + 1, K)).bitwiseAND(F.lit(-PLACES).cast("bigint")).bitwiseOR(F.pmod(i, F.lit(PLACES)).cast("bigint")),
        )

    # Bound twice: an expression inside a lambda would be computed for each of its elements.
    return let(hashes, lambda known: let(grams(known), of_grams))


def _runs(hashes: Column, length: int) -> Column:
    """All runs of ``length`` words."""
    return F.transform(
        _upto(F.size(hashes) - length), lambda i: _mark(i, length, F.xxhash64(F.lit(length), F.slice(hashes, i + 1, length)))
    )


def marks(text: Column, lengths: list[int]) -> Column:
    """What a text is looked up by: winnowed k-grams, and all runs of the given lengths."""

    def of_hashes(hashes: Column) -> Column:
        kinds = [winnowed(hashes), *(_runs(hashes, n) for n in lengths)]
        return F.concat(*kinds) if lengths else kinds[0]

    return let(_hashes(words_of(text)), of_hashes)


def window_key(words: Column, at: Column, length: Column) -> Column:
    """SHA-256 of a run of words, which hold no blanks."""
    return F.unhex(F.sha2(F.concat_ws(" ", F.slice(words, at + 1, length)), 256))


def benchmark_classes(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(class, words) and (class, item): items whose words are the same are one class; items without words are left out."""
    chosen = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), words_of(F.col(f"`{text}`")).alias("words"))
    keyed = materialise(
        chosen.where(F.size("words") > 0).select("item", "words", F.unhex(F.sha2(F.concat_ws(" ", "words"), 256)).alias("class")), "benchmark"
    )
    return keyed.groupBy("class").agg(F.first("words").alias("words")), keyed.select("class", "item").distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, hits (sorted (at, length) of the shared windows), n_hit, items (sorted texts of ids).

    A null text or one without words has no hits; so has any document where the benchmark is empty. A null item id is
    the empty text; items of one id count once. Repeated rows have equal results; other columns aren't read. An empty
    table gives no rows. Documents with no kept hash in common with the benchmark are read, and nothing of them is shuffled
    but, for the result, their identity and number of words.
    """
    classes, members = benchmark_classes(benchmark, item, item_text)
    sized = classes.select("class", "words", F.size("words").alias("n"))
    short = sorted(r.n for r in sized.where(F.col("n") < WINDOW).select("n").distinct().collect())  # at most WINDOW - 1 numbers
    starts = F.transform(_upto(F.greatest(F.col("n") - WINDOW, F.lit(0))), lambda i: F.struct(i.alias("at"), F.least("n", F.lit(WINDOW)).alias("length")))
    spots = sized.select("class", "words", F.explode_outer(starts).alias("s"))
    windows = spots.select("class", window_key(F.col("words"), F.col("s.at"), F.col("s.length")).alias("window")).distinct()
    windows = materialise(windows, "windows")

    def own(n: int) -> Column:  # a short item's only run
        return F.array(_mark(F.lit(0), n, F.xxhash64(F.lit(n), _hashes(F.col("words")))))

    kept = winnowed(_hashes(F.col("words")))
    for n in short:
        kept = F.when(F.col("n") == n, own(n)).otherwise(kept)
    known = materialise(sized.select(F.inline_outer(kept)).select("length", "mark").where(F.col("mark").isNotNull()).distinct(), "marks")

    identity = [c.alias(n) for c, n in zip(row_identity(key, text), IDENTITY, strict=True)]
    texts = docs.select(*identity, F.col(f"`{text}`").alias("text"))
    # inline_outer: an inner one would compute the marks a second time, to filter texts without any.
    looked = texts.select(*IDENTITY, F.inline_outer(marks(F.col("text"), short)))
    spots = looked.join(known, ["length", "mark"], "left_semi").groupBy(*IDENTITY).agg(F.collect_set(F.struct("at", "length")).alias("spots"))
    spots = materialise(spots, "spots")

    def around(words: Column) -> Column:
        def extended(spot: Column) -> Column:
            first = F.greatest(spot["at"] - (WINDOW - K), F.lit(0))
            last = F.least(spot["at"], F.size(words) - WINDOW)
            run = F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("at"), F.lit(WINDOW).alias("length")))
            return F.when(spot["length"] == WINDOW, run).otherwise(F.array(spot))

        places = F.array_distinct(F.flatten(F.transform(F.col("spots"), extended)))
        return F.transform(
            places, lambda p: F.struct(p["at"].alias("at"), p["length"].alias("length"), window_key(words, p["at"], p["length"]).alias("window"))
        )

    near = texts.join(spots, IDENTITY)
    tried = near.select(*IDENTITY, F.inline_outer(let(words_of(F.col("text")), around)))
    shared = tried.join(windows.select("window").distinct(), "window", "left_semi").distinct()
    shared = materialise(shared, "shared")
    hits = shared.groupBy(*IDENTITY).agg(F.sort_array(F.collect_set(F.struct("at", "length"))).alias("hits"))
    pairs = shared.select(*IDENTITY, "window").distinct().join(windows, "window").select(*IDENTITY, "class").distinct()
    named = pairs.join(members, "class").groupBy(*IDENTITY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = materialise(hits.join(named, IDENTITY), "hits")

    held = fresh(docs, *IDENTITY)
    counted = docs.select(
        F.col(f"`{key}`"), *(c.alias(n) for c, n in zip(row_identity(key, text), held, strict=True)),
        F.size(words_of(F.col(f"`{text}`"))).cast("bigint").alias("n_words"),
    )
    joined = counted.join(found.withColumnsRenamed(dict(zip(IDENTITY, held, strict=True))), held, "left")
    return joined.select(
        F.col(f"`{key}`"), "n_words", F.coalesce("hits", F.array().cast("array<struct<at:int,length:int>>")).alias("hits"),
        F.coalesce(covered(F.col("hits")), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(hits: Column) -> Column:
    """Words inside any of the runs (at, length), which are sorted."""

    def add(state: Column, hit: Column) -> Column:
        end = hit["at"] + hit["length"]
        new = F.greatest(end - F.greatest(hit["at"], state["reach"]), F.lit(0))
        return F.struct(F.greatest(end, state["reach"]).alias("reach"), (state["words"] + new).alias("words"))

    return F.aggregate(hits, F.struct(F.lit(0).alias("reach"), F.lit(0).alias("words")), add, lambda s: s["words"])


def clean_share(hits: Column, words: Column) -> Column:
    """Share of a document's words outside all hits; 1 for one without words."""
    return F.when(words > 0, 1 - covered(hits) / words).otherwise(F.lit(1.0))
