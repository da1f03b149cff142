"""Token ids of documents as flat binary files.

A folder holds shards: ``shard-N.bin``, the ids of its documents behind one another as little-endian unsigned
integers of 16 bits (32 for vocabularies that need them), and ``shard-N.idx``, a header of four 64-bit numbers (bytes per id,
documents, ids, version) with 64-bit document offsets, keys and null marks of keys. ``manifest.json`` has the number of documents and ids before
each shard: prefix sums over the partitions. Ids of one document are read by mapping the file into memory and
looking at two offsets; from a store that can't be mapped, the same range of bytes is fetched.

Shards are written under a name of the attempt and then renamed, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import give_back

END_ID = 1
#: Words of either dictionary of an encoder, about 160 bytes each.
CACHED_WORDS = 250_000
_WHITE = "\n\t\r\x0b\x0c"
_HEADER = 4


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Ids of texts for a tokenizer that drops white space, as bytes; a dictionary from word to its ids.

    No token of such a tokenizer spans white space, so a text's ids are those of its words in order, and a word is
    encoded once for as long as it is remembered. After ``CACHED_WORDS`` words the dictionary starts anew and the words
    before are kept aside until it is full again, so those that come often stay.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self._aside: dict[str, bytes] = {}
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self._end = np.array([end_id], self.dtype).tobytes()
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        if "Replace" not in json.dumps(rules["normalizer"]) or "Removed" not in json.dumps(rules["pre_tokenizer"]):
            raise ValueError(f"{path} doesn't drop white space")
        # How the byte-level step writes the letters of Latin-1.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        spelled = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self._spelled = {b: s for b, s in spelled.items() if chr(b) != s}

    def __missing__(self, word: str) -> bytes:
        found = self._aside.get(word)
        if found is not None:
            pass
        elif word.isalpha() and (word.isascii() or max(word) <= "\xff"):  # one word, no marks to compose
            lower = word.lower()
            if lower != word:
                found = self[lower]
            else:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self._spelled)
                found = np.array([t.id for t in self._model.tokenize(spelled)], self.dtype).tobytes()
        elif word[-1:] in (".", ",") and word[:-1].isalpha():  # letters and the mark are split in any case
            found = self[word[:-1]] + self[word[-1]]
        else:
            found = np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
        self[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of the text, then the end id; null is empty."""
        if len(self) > CACHED_WORDS:
            self._aside = dict(self)
            self.clear()
        text = text or ""
        for white in _WHITE:
            if white in text:
                text = text.replace(white, " ")
        return b"".join(map(self.__getitem__, text.split(" "))) + self._end


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    return WordEncoder(path, end_id)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri.rstrip("/")))


def _read(fs: pafs.FileSystem, path: str, dtype: np.dtype) -> np.ndarray:
    """A whole file as an array: mapped where the file system is local."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if fs.get_file_info(path).size else np.zeros(0, dtype)
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype=dtype)


@dataclass
class Shard:
    ids: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray
    nulls: np.ndarray

    @classmethod
    def open(cls, uri: str, number: int) -> Shard:
        fs, folder = file_system(uri)
        index = _read(fs, f"{folder}/shard-{number:05d}.idx", np.dtype("<i8"))
        width, documents = int(index[0]), int(index[1])
        offsets, keys, nulls = np.split(index[_HEADER:], [documents + 1, 2 * documents + 1])
        return cls(_read(fs, f"{folder}/shard-{number:05d}.bin", np.dtype(f"<u{width}")), offsets, keys, nulls)

    def __len__(self) -> int:
        return len(self.keys)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]

    def key_array(self) -> pa.Array:
        return pa.array(np.asarray(self.keys), pa.int64(), mask=np.asarray(self.nulls).astype(bool))


_WRITTEN = "shard int, documents bigint, ids bigint"


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text",
    ordered: bool = True,
) -> list[dict]:
    """Encode every text, append ``end_id``, write shards and the manifest; the manifest's entries.

    With ``ordered`` documents are in ascending order of the key over all shards (null first, equal keys by text);
    otherwise a shard has the documents of one input partition and nothing is shuffled. A null text is empty and has the
    end id alone. Other columns aren't read. An empty table has a manifest without shards.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        give_back()
        encode = encoder(tokenizer, end_id)
        fs, folder = file_system(path)
        draft = f"{folder}/attempt-{number:05d}-{attempt}"
        keys, lengths, file = [], [], None
        for batch in batches:
            if batch.num_rows and file is None:
                file = fs.open_output_stream(f"{draft}.bin")
            keys += batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 256):
                found = [encode.encode(t) for t in batch.column(1).slice(at, 256).to_pylist()]
                lengths += [len(f) // encode.dtype.itemsize for f in found]
                file.write(b"".join(found))
        if file is None:
            return
        file.close()
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        header = [encode.dtype.itemsize, len(keys), offsets[-1], 1]
        nulls = [k is None for k in keys]
        index = np.concatenate((header, offsets, [k or 0 for k in keys], nulls)).astype("<i8")
        with fs.open_output_stream(f"{draft}.idx") as out:
            out.write(index.tobytes())
        for end in ("bin", "idx"):
            fs.move(f"{draft}.{end}", f"{folder}/shard-{number:05d}.{end}")
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([number], pa.int32()), "documents": [len(keys)], "ids": [int(offsets[-1])]}
        )

    fs, folder = file_system(path)
    fs.create_dir(folder, recursive=True)
    chosen = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    if ordered:
        chosen = chosen.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(
            F.col("key").asc_nulls_first(), "text"
        )
    written = chosen.mapInArrow(write, _WRITTEN).collect()  # one row per partition
    shards = sorted((r.asDict() for r in written), key=lambda r: r["shard"])
    documents = ids = 0
    for shard in shards:  # prefix sums: what lies before each shard
        shard |= {"first_document": documents, "first_id": ids}
        documents, ids = documents + shard["documents"], ids + shard["ids"]
    with fs.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps({"version": 1, "documents": documents, "ids": ids, "shards": shards}).encode())
    return shards


def read_manifest(path: str) -> list[dict]:
    fs, folder = file_system(path)
    with fs.open_input_file(f"{folder}/manifest.json") as file:
        return json.loads(file.read())["shards"]


def over_shards(spark: SparkSession, numbers: list[int]) -> DataFrame:
    """One row and one task per shard; column ``at`` counts the list."""
    return spark.range(0, len(numbers), 1, max(1, len(numbers))).select(F.col("id").alias("at"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, start (ids before it), n_tokens, ids (little-endian
    unsigned 32-bit)."""
    shards = read_manifest(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                shard = Shard.open(path, shards[at]["shard"])
                keys = shard.key_array()
                for first in range(0, len(shard), 512):
                    some = range(first, min(first + 512, len(shard)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.slice(first, len(some)),
                            pa.array([shards[at]["first_id"] + int(shard.offsets[i]) for i in some], pa.int64()),
                            pa.array([int(shard.offsets[i + 1] - shard.offsets[i]) for i in some], pa.int64()),
                            pa.array([shard.document(i).astype("<u4").tobytes() for i in some], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return over_shards(spark, shards).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
