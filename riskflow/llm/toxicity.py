"""Convolutional text classifier for toxicity, trained in numpy.

A word is the sum of two hashed embeddings, its own and that of its first bytes, so endings that training has not
seen still say something. Filters of several widths run over the words of a text, each keeps its largest
answer, and a linear layer makes the score. Thresholds are calibrated by language: the language is guessed from
the words (never from a column), and each language's best threshold on held-back training rows becomes ``THRESHOLD``.

Training sees at most ``MAX_ROWS`` labelled rows, the first by a hash of their key. Scoring is one pass over all texts,
without a shuffle; the model has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.functions.hashing import hash_text
from riskflow.llm.common import RollingHash, bytes_of, mix, slices, word_bounds

MAX_ROWS = 12_000
WORD_BUCKETS = 1 << 18
PREFIX_BUCKETS = 1 << 16
LANGUAGE_BUCKETS = 1 << 14
PREFIX_BYTES = 4
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 4
BATCH = 64
STRETCH = 1 << 15  # words that are embedded at a time
RATE = 0.1
THRESHOLD = 0.7
FRAGMENTS = 0.3
SEED = 5
CALIBRATION_SHARE = 5  # one training row of so many sets thresholds instead

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?\"')"]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (word bucket, prefix bucket) of all words, and the first word of each text (one more at the end).

    Words are lower-cased in A-Z and lose one mark of punctuation at the end. Bucket 0 is kept for gaps.
    """
    starts, ends, first = word_bounds(data, offsets)
    ends = np.where((ends - starts > 1) & _PUNCTUATION[data[ends - 1]], ends - 1, ends) if len(ends) else ends
    rolling = RollingHash(data, lower=True)
    words = mix(rolling.of(starts, ends)) % np.uint64(WORD_BUCKETS - 1)
    prefixes = mix(rolling.of(starts, np.minimum(ends, starts + PREFIX_BYTES))) % np.uint64(PREFIX_BUCKETS)
    return np.stack([words + np.uint64(1), prefixes + np.uint64(WORD_BUCKETS)], axis=1).astype(np.int32), first


class Network:
    """Embeddings, filters and output layer; ``forward`` and one step of training."""

    def __init__(self, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.table = draw.uniform(-0.1, 0.1, (WORD_BUCKETS + PREFIX_BUCKETS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.filters = [draw.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = draw.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(-2.0)
        self._seen = np.zeros(len(self.table), dtype=bool)
        self._squares = {n: np.full(np.shape(getattr(self, n)), 1e-3, np.float32) for n in ("table", "bias", "out")}
        self._filter_squares = [np.full(f.shape, 1e-3, np.float32) for f in self.filters]

    def _spread(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows with gaps between texts as long as a filter can reach, and where each text starts and ends in them."""
        gap = max(WIDTHS) - 1
        texts = np.arange(len(first) - 1)
        begin, end = first[:-1] + gap * texts, first[1:] + gap * texts
        laid = np.zeros((len(rows) + gap * (len(texts) + 1), 2), np.int32)
        laid[np.arange(len(rows)) + gap * np.repeat(texts, np.diff(first))] = rows
        return laid, begin, end

    def _embedded(self, words: np.ndarray) -> np.ndarray:
        return self.table[words[..., 0]] + self.table[words[..., 1]] * (words[..., 1:] > 0)

    def _pooled(self, rows: np.ndarray, first: np.ndarray, places: bool = False):
        """Each filter's largest answer in each text, which texts have words, the spread rows and, with ``places``, where in them
        the answers are (the first of equal ones). ``STRETCH`` rows are embedded at a time, however long a text is."""
        laid, begin, end = self._spread(rows, first)
        filled = end > begin
        pooled = np.full((len(begin), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        at = np.zeros(pooled.shape, np.int64)
        reach = len(laid) - max(WIDTHS) + 1
        for low in range(0, reach, STRETCH):
            high = min(low + STRETCH, reach)
            embedded = self._embedded(laid[low : high + max(WIDTHS) - 1])
            answers = np.concatenate(
                [sum(embedded[j : j + high - low] @ f[j] for j in range(len(f))) for f in self.filters], axis=1
            )
            here = np.arange(np.searchsorted(end, low, side="right"), np.searchsorted(begin, high))
            here = here[filled[here]]
            if not len(here):
                continue
            opens, closes = np.maximum(begin[here], low) - low, np.minimum(end[here], high) - low
            edges = np.stack([opens, closes], axis=1).ravel()
            best = np.maximum.reduceat(answers, edges[: -1 if edges[-1] >= len(answers) else None], axis=0)[::2]
            better = best > pooled[here]
            pooled[here] = np.where(better, best, pooled[here])
            if places:
                found = np.stack([low + a + answers[a:b].argmax(axis=0) for a, b in zip(opens, closes, strict=True)])
                at[here] = np.where(better, found, at[here])
        pooled[~filled] = 0
        return pooled, filled, laid, at

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        pooled, filled, _, _ = self._pooled(rows, first)
        return np.maximum(pooled + self.bias, 0) * filled[:, None] @ self.out + self.base

    def _adapt(self, name: str, slope: np.ndarray) -> None:
        self._squares[name] += slope**2
        setattr(self, name, getattr(self, name) - RATE * slope / np.sqrt(self._squares[name]))

    def step(self, rows: np.ndarray, first: np.ndarray, target: np.ndarray) -> None:
        """One step of Adagrad on the mean log loss; only the words behind each filter's largest answer move."""
        pooled, filled, laid, at = self._pooled(rows, first, places=True)
        hidden = np.maximum(pooled + self.bias, 0) * filled[:, None]
        wrong = (1 / (1 + np.exp(-(hidden @ self.out + self.base))) - target) / len(target)
        back = wrong[:, None] * self.out * (hidden > 0)
        moved, slopes = [], []
        for k, f in enumerate(self.filters):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            change = np.zeros_like(f)
            for j in range(len(f)):
                place, slope = at[:, own] + j, back[:, own]
                change[j] = np.einsum("dfe,df->ef", self._embedded(laid[place]), slope)
                moved.append(laid[place].reshape(-1, 2))
                slopes.append((slope[:, :, None] * f[j].T).reshape(-1, DIM))
            self._filter_squares[k] += change**2
            f -= RATE * change / np.sqrt(self._filter_squares[k])
        slope = np.concatenate(slopes)
        live = np.abs(slope).any(axis=1)
        ids = np.concatenate(moved)[live].T.ravel()
        ids, back_to = np.unique(ids, return_inverse=True)
        total = np.zeros((len(ids), DIM), np.float32)
        np.add.at(total, back_to, np.concatenate([slope[live]] * 2))
        total[ids == 0] = 0
        self._seen[ids] = True
        self._squares["table"][ids] += total**2
        self.table[ids] -= RATE * total / np.sqrt(self._squares["table"][ids])
        self._adapt("out", hidden.T @ wrong)
        self._adapt("bias", back.sum(axis=0))
        self.base -= np.float32(RATE * wrong.sum())

    def settle(self) -> None:
        """Words that training never moved say nothing; drop what only training needs."""
        self.table[~self._seen] = 0
        del self._seen, self._squares, self._filter_squares


@dataclass
class Model:
    """``network`` is None where training had no rows of both labels; every text then has the score ``share``."""

    network: Network | None
    share: float
    languages: np.ndarray  # log odds of each language by word bucket
    thresholds: np.ndarray  # logit that becomes THRESHOLD, by language
    slope: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, self.share)
        rows, first = features(data, offsets)
        logits = self.network.logits(rows, first)
        shifted = self.slope * (logits - self.thresholds[self.language(rows, first)])
        return 1 / (1 + np.exp(-np.clip(shifted + np.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)))

    def language(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest language of each text by its words; the first of all for a text without words."""
        sums = np.zeros((len(first) - 1, self.languages.shape[1]))
        for low in range(0, len(rows), STRETCH):
            odds = self.languages[rows[low : low + STRETCH, 0] % LANGUAGE_BUCKETS].astype(np.float64)
            here = np.arange(np.searchsorted(first[1:], low, side="right"), np.searchsorted(first[:-1], low + len(odds)))
            here = here[first[here + 1] > first[here]]
            sums[here] += np.add.reduceat(odds, np.maximum(first[here] - low, 0), axis=0)
        return sums.argmax(axis=1)


def fit(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None]) -> Model:
    """Train on the rows of ``features`` of each text; a fixed seed, so the same rows give the same model."""
    labels = np.asarray(labels, dtype=np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    names = sorted({x or "" for x in langs})
    held = np.arange(len(labels)) % CALIBRATION_SHARE == CALIBRATION_SHARE - 1
    if min(labels[~held].sum(), (1 - labels[~held]).sum(), labels[held].sum(), (1 - labels[held]).sum()) < 1:
        return Model(None, share, np.zeros((LANGUAGE_BUCKETS, 1)), np.zeros(1), 1.0)
    spoken = np.array([names.index(x or "") for x in langs])
    counts = np.full((LANGUAGE_BUCKETS, len(names)), 0.5)
    for rows, i in zip(texts, spoken, strict=True):
        counts[:, i] += np.bincount(rows[:, 0] % LANGUAGE_BUCKETS, minlength=LANGUAGE_BUCKETS)
    odds = np.log(counts / counts.sum(axis=0))
    odds -= odds.mean(axis=1, keepdims=True)

    network, draw = Network(), np.random.default_rng(SEED)
    # Short pieces of clean texts, some without words: a text that says little is not toxic.
    clean = [texts[i] for i in np.flatnonzero(~held & (labels == 0)) if draw.random() < FRAGMENTS]
    starts = [int(draw.integers(0, len(t) + 1)) for t in clean]
    seen = [texts[i] for i in np.flatnonzero(~held)] + [t[a : a + int(draw.integers(0, 12))] for t, a in zip(clean, starts, strict=True)]
    target = np.concatenate((labels[~held], np.zeros(len(clean), np.float32)))
    for _ in range(EPOCHS):
        order = draw.permutation(len(seen))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            network.step(*joined([seen[j] for j in some]), target[some])
    network.settle()

    model = Model(network, share, odds.astype(np.float32), np.zeros(len(names)), 1.0)
    kept = np.flatnonzero(held)
    logits, guessed = np.zeros(len(kept)), np.zeros(len(kept), int)
    for i in range(0, len(kept), BATCH):
        rows, first = joined([texts[j] for j in kept[i : i + BATCH]])
        logits[i : i + BATCH] = network.logits(rows, first)
        guessed[i : i + BATCH] = model.language(rows, first)
    common = best_threshold(logits, labels[kept])
    floor = float(network.logits(np.zeros((0, 2), np.int32), np.zeros(2, np.int64))[0]) + 0.1  # above a text without words
    for i in range(len(names)):
        own = guessed == i
        enough = min((labels[kept][own] > 0).sum(), (labels[kept][own] == 0).sum()) >= 10
        model.thresholds[i] = max(floor, best_threshold(logits[own], labels[kept][own]) if enough else common)
    model.slope = 4 / max(1.0, float(np.abs(logits - common).mean()))
    return model


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap between two scores where calling everything above it toxic has the largest F1."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    score = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    i = int(score.argmax())
    below = logits[order[i + 1]] if i + 1 < len(order) else logits[order[i]] - 2.0
    return float((logits[order[i]] + below) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, lang: str, limit: int) -> list:
    """(key, label, language, features as bytes) of the first ``limit`` labelled keys by a hash of the key; of rows with one key
    that with the smallest hash of its text."""
    chosen = (
        labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"))
        .where("key IS NOT NULL AND label IS NOT NULL")
        .groupBy("key").agg(F.max("label").alias("label"))
        .orderBy(hash_text("key", SEED), "key").limit(limit)
    )
    texts = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")
    )
    one = F.min(F.struct(F.xxhash64("text").alias("tie"), "lang", "text")).alias("one")
    found = (
        texts.join(F.broadcast(chosen), "key").groupBy("key", F.col("label").cast("int").alias("label")).agg(one)
        .select("key", "label", "one.lang", "one.text")
    )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, first = features(*bytes_of(batch.column("text")))
            packed = [rows[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(packed, pa.binary())], names=["key", "label", "lang", "words"]
            )

    kind = chosen.schema["key"].dataType.simpleString()
    rows = found.mapInArrow(reduce, f"key {kind}, label int, lang string, words binary").toArrow().to_pylist()
    return sorted(rows, key=lambda r: (r["key"], r["words"]))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", lang: str = "lang",
    max_rows: int = MAX_ROWS,
) -> Model:
    """Fit on the texts of ``docs`` that ``labels`` marks 0 or 1. Rows without key or label are left out; a key with
    several labels counts as toxic if one says so, and one row of each key is read. Null and empty texts are texts without words.
    Without rows of both labels, an empty table included, every text gets the share of toxic ones (0 without rows)."""
    rows = training_rows(docs, labels, label, key, text, lang, max_rows)
    texts = [np.frombuffer(r["words"], np.int32).reshape(-1, 2) for r in rows]
    return fit(texts, np.array([r["label"] for r in rows]), [r["lang"] for r in rows])


def score(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """Append column ``name``: the score of each whole text, 0 to 1; ``THRESHOLD`` and more is toxic. Null and empty
    texts have the score of a text without words. The score depends on the text alone, so repeated rows share it. A column
    that is called ``name`` already, in any case, is replaced. An empty table gives no rows."""
    fields = [f for f in docs.schema.fields if f.name.lower() != name.lower()]
    columns = [*(f.name for f in fields), name]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in slices(batches, columns[-1]):
            found = scorer.scores(*bytes_of(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=columns)

    wide = docs.select(*(F.col(f"`{f.name}`") for f in fields), F.col(f"`{text}`").cast("binary").alias(name))
    return wide.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def held_out(key: str) -> Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; false without a key."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
