"""I-Match fingerprints with DataFrame functions only.

A document's terms are its distinct lower-cased words. Terms whose inverse document frequency lies in a band make the
lexicon; a document's fingerprint is a list of hashes, each over its sorted lexicon terms in one randomised subset
of the lexicon. Sixteen subsets divide the lexicon by bits of the terms' hashes; sixteen more divide a random half of
it, then of a quarter, and so on. So long and short documents both have subsets with one or two of their
terms, and a document that shares much of its text with another agrees with it in some of those.

Document frequencies are counted by hashed bucket, over all documents; the lexicon is then one flag a bucket, an array of
fixed size whatever the number of words, and no document is ever joined with its terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import fresh
from riskflow.session import materialise

BUCKET_BITS = 18
LOW_IDF = math.log(20)
HIGH_IDF = math.log(1000)
SLOT_BITS = 4
LEVELS = 8
DIGITS = 4
EMPTY = "-" * DIGITS
COARSE = 256


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the words (runs without 0x20, 0x09-0x0D) of a text; null has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _bucket(term: Column) -> Column:
    return F.pmod(term, F.lit(1 << BUCKET_BITS)).cast("int")


def lexicon(docs: DataFrame, text: str, low: float = LOW_IDF, high: float = HIGH_IDF) -> DataFrame:
    """One row, ``flags``: a bit for each bucket, 64 to a number, set where ln(documents / documents with its terms) is
    between ``low`` and ``high``. Every document counts."""
    narrow = docs.select(term_hashes(F.col(f"`{text}`")).alias("terms"))
    found = (
        narrow.select(F.explode(F.array_distinct(F.transform("terms", _bucket))).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("holders"))
        .withColumn("documents", docs.select(F.count(F.lit(1)).alias("n")).scalar())
        .where(F.ln(F.col("documents") / F.col("holders")).between(low, high))
        .groupBy(F.floor(F.col("bucket") / 64).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bucket") % 64)).alias("bits"))
    )
    flags = (
        docs.sparkSession.range(1 << BUCKET_BITS - 6).select(F.col("id").alias("word"))
        .join(found, "word", "left")
        .agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("pairs"))
    )
    return materialise(flags.select(F.transform("pairs", lambda p: p["bits"]).alias("flags")), "lexicon")


def _flagged(flags: Column, term: Column) -> Column:
    bucket = _bucket(term)
    return _unsigned(F.get(flags, F.floor(bucket / 64).cast("int")), bucket % 64).bitwiseAND(F.lit(1)) == 1


def with_fingerprint(df: DataFrame, text: str, flags: DataFrame, name: str) -> DataFrame:
    """Append ``name``: an array of hashes, ``DIGITS`` hexadecimal digits for each subset, ``EMPTY`` for one without terms.

    A text without any lexicon term uses all its terms. Equal texts have equal fingerprints; texts without words have
    empty subsets only.
    """
    every, known, member, *levels = fresh(df, "every_term", "known_terms", "flags", *(f"terms_{i}" for i in range(LEVELS)))
    kept = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumn(every, term_hashes(F.col(f"`{text}`"))).withColumn(member, flags.select("flags").scalar())
    held = hashed.select(*kept, every, F.filter(every, lambda t: _flagged(F.col(member), t)).alias(known))
    thinned = held.select(*kept, F.sort_array(F.when(F.size(known) > 0, F.col(known)).otherwise(F.col(every))).alias(levels[0]))
    for i in range(1, LEVELS):  # each level keeps the terms with one more bit at zero
        thinned = thinned.withColumn(levels[i], _thinned(F.col(levels[i - 1]), BUCKET_BITS + SLOT_BITS + i))

    def digests(level: str) -> Column:
        def digest(slot: Column) -> Column:
            inside = F.filter(level, lambda t: _bits(t, BUCKET_BITS, (1 << SLOT_BITS) - 1) == slot)
            marks = F.substring(F.lower(F.lpad(F.hex(F.xxhash64(inside)), 16, "0")), 17 - DIGITS, DIGITS)
            return F.when(F.size(inside) > 0, marks).otherwise(F.lit(EMPTY))

        return F.transform(F.sequence(F.lit(0), F.lit((1 << SLOT_BITS) - 1)), digest)

    return thinned.select(*kept, F.concat(*(digests(level) for level in levels)).alias(name))


def _thinned(terms: Column, bit: int) -> Column:
    return F.filter(terms, lambda t: _bits(t, bit, 1) == 0)


def _bits(term: Column, shift: int, mask: int) -> Column:
    return _unsigned(term, F.lit(shift)).bitwiseAND(F.lit(mask))


def _unsigned(value: Column, shift: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, shift)


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets with equal hashes, of those in which either text has terms; 1 if neither has any."""
    either = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), F.lit(0)).otherwise(F.lit(1)))
    equal = F.zip_with(a, b, lambda x, y: F.when((x == y) & (x != EMPTY), F.lit(1)).otherwise(F.lit(0)))
    both = F.struct(_total(equal).alias("equal"), _total(either).alias("either"))
    return F.when(both["either"] > 0, both["equal"].cast("double") / both["either"]).otherwise(F.lit(1.0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def with_next(df: DataFrame, key: str, text: str, derive: Callable[[DataFrame], DataFrame], derived: str, prefix: str) -> DataFrame:
    """``derive(df)``, which appends ``derived``, with ``text`` and ``derived`` of the next row by descending ``key`` under
    ``prefix``; after the last row comes the first.

    ``key`` is a bigint; null comes last, equal keys by a hash of the text. Rows go to ranges of the key, one shuffle; the
    last row of a range takes what the first row of the next range has, from a table of one row a range.
    """
    carried = [text, derived]
    part, tie, order = fresh(df, "range", "tie", "range_order")
    session = df.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 1)
    coarse, fine = min(parts, COARSE), -(-parts // COARSE)
    shares = F.array(*(F.lit(i / coarse) for i in range(coarse + 1)))
    bounds = df.agg(F.percentile_approx(key, shares, 10_000).alias("b")).first().b or [0]
    edges = sorted(set(bounds))
    steps = F.array(*(F.lit(b).cast("bigint") for b in edges))
    cell = F.size(F.filter(steps, lambda b: b <= F.col(key)))
    low, high = F.get(steps, cell - 1), F.get(steps, cell)
    inner = F.when((cell > 0) & (high > low), F.floor((F.col(key) - low) * fine / (high - low))).otherwise(F.lit(0))
    ranged = df.withColumn(part, F.coalesce((cell * fine + inner).cast("bigint"), F.lit(-1).cast("bigint")) if fine > 1 else F.when(F.col(key).isNull(), F.lit(-1)).otherwise(cell).cast("bigint"))
    ranged = ranged.withColumn(tie, F.xxhash64(F.col(text)))
    window = Window.partitionBy(part).orderBy(F.col(key).desc_nulls_last(), F.col(tie).desc())
    led = derive(ranged).select("*", *(F.lead(c).over(window).alias(f"{prefix}{c}") for c in carried), F.lead(F.lit(1)).over(window).alias(order))
    # The first row of each range: its key and tie are few numbers, its other columns are read again by them.
    heads = ranged.groupBy(part).agg(F.max(F.struct(F.coalesce(F.col(key), F.lit(0)).alias("k"), F.col(tie).alias("t"))).alias("head"))
    heads = materialise(heads.select(part, "head.k", "head.t"), "heads")
    following = Window.orderBy(F.col(part).desc())
    top = heads.agg(F.max(part).alias("m"))
    chain = heads.select(F.col(part).alias("from_range"), F.coalesce(F.lead(part).over(following), top.scalar()).alias("to_range"))
    # One row a range, so a table of as many rows as there are shuffle partitions.
    found = ranged.join(F.broadcast(heads), part).where((F.coalesce(F.col(key), F.lit(0)) == F.col("k")) & (F.col(tie) == F.col("t")))
    first = derive(materialise(found.select(part, text), "heads")).groupBy(part).agg(*(F.first(c).alias(f"head_{c}") for c in carried))
    linked = materialise(chain.join(first, F.col("to_range") == F.col(part)).drop(part, "to_range"), "heads")
    joined = led.join(linked, F.col(part) == F.col("from_range"))
    return joined.select(
        *(F.col(f"`{c}`") for c in df.columns),
        derived,
        *(F.when(F.col(order).isNull(), F.col(f"head_{c}")).otherwise(F.col(f"{prefix}{c}")).alias(f"{prefix}{c}") for c in carried),
    )


def edited_text(text: Column, following: Column) -> Column:
    """The last half (rounded down) of the code points replaced by as many from the start of ``following``, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. Documents come by descending key (null last, equal keys by a hash of the text). Other columns
    aren't read. An empty table gives no rows.
    """
    chosen = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    flags = lexicon(chosen, "text")
    paired = with_next(chosen, "key", "text", lambda df: with_fingerprint(df, "text", flags, "marks"), "marks", "next_")
    edited = paired.withColumn("edited", edited_text(F.col("text"), F.col("next_text"))).select(
        "key", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "edited", "marks", "next_marks"
    )
    final = with_fingerprint(edited, "edited", flags, "edited_marks")
    return final.select(
        F.col("key").alias(key), "n_chars", "edited_sha256",
        F.concat_ws("", "marks").alias("fingerprint"), F.concat_ws("", "edited_marks").alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
