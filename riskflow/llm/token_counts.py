"""Token counts by a linear longest-match automaton.

Greedy word-piece: from the left, the longest piece of the vocabulary that starts there is taken. The automaton is
the trie of the vocabulary in which each node has a failure link, the node reached when the pieces that are
certain by then have been taken off the front, and the number of those pieces. A word is read once, letter by
letter, and its length in pieces is the sum of the numbers on the links followed: no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INITIAL = "▁"
CACHED_WORDS = 300_000
_WHITE = "\n\t\r\x0b\x0c"
_NONE = -1


class LongestMatch(dict):
    """Pieces of words; a dictionary from word to count, -1 for a word that can't be spelled with the vocabulary."""

    def __init__(self, vocabulary: Iterable[str], initial: str = INITIAL) -> None:
        super().__init__()
        self._initial = initial
        self._next: list[dict[str, int]] = [{}]
        ends = set()
        for piece in vocabulary:
            node = 0
            for letter in piece:
                if letter not in self._next[node]:
                    self._next[node][letter] = len(self._next)
                    self._next.append({})
                node = self._next[node][letter]
            ends.add(node)
        ends.discard(0)
        self._link(ends)

    def _link(self, ends: set[int]) -> None:
        """Failure links and popped counts, parents before children."""
        self._fail = [_NONE] * len(self._next)
        self._pops = [0] * len(self._next)
        queue = [0]
        for parent in queue:
            for letter, node in self._next[parent].items():
                queue.append(node)
                if node in ends:
                    self._fail[node], self._pops[node] = 0, 1
                    continue
                at, popped = self._fail[parent], self._pops[parent]
                while at != _NONE and letter not in self._next[at]:
                    popped += self._pops[at]
                    at = self._fail[at]
                if at != _NONE:
                    self._fail[node], self._pops[node] = self._next[at][letter], popped

    def __missing__(self, word: str) -> int:
        found = self[word] = self._count(self._initial + word)
        return found

    def _count(self, word: str) -> int:
        following, fail, pops = self._next, self._fail, self._pops
        node = count = 0
        for letter in word:
            while letter not in following[node]:
                count += pops[node]
                node = fail[node]
                if node == _NONE:
                    return _NONE
            node = following[node][letter]
        while node:
            count += pops[node]
            node = fail[node]
            if node == _NONE:
                return _NONE
        return count

    def text(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and words that can't be spelled, each of which is one token."""
        if len(self) > CACHED_WORDS:
            self.clear()
        text = text or ""
        for white in _WHITE:
            if white in text:
                text = text.replace(white, " ")
        counts = [self[w] for w in text.split(" ") if w]
        unknown = counts.count(_NONE)
        return len(counts), sum(counts) + 2 * unknown, unknown


def piece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentence-piece model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    special = (model.is_unknown, model.is_control, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(test(i) for test in special)]


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(piece_vocabulary(path))


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_tokens, n_unknown.

    Words are runs without white space (0x20, 0x09-0x0D), and start with the model's mark of a word's start. A word that can't
    be spelled is one token. Null and empty texts count 0. Other columns aren't read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = automaton(model)
        for batch in batches:
            counts = [counter.text(t) for t in batch.column(1).to_pylist()]
            columns = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[key, "n_words", "n_tokens", "n_unknown"]
            )

    chosen = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    kind = docs.schema[key].dataType.simpleString()
    return chosen.mapInArrow(count, f"`{key}` {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
