"""Byte-pair encoding and decoding with a given vocabulary.

A piece of text is a doubly linked list of symbols. A heap holds the merge rank
of each neighbouring pair; the lowest is merged, and entries whose symbols have
changed since are skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import tokens
from lamina.llm.common import documents

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text into the pieces inside which symbols merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of words, with their ids and what a dictionary adds, that a worker remembers, and of the longest such word. Half of them make a generation; words not met for one are forgotten, so this bounds memory, not results.
REMEMBERED, LONGEST, ENTRY = 96 << 20, 64, 200
#: Bytes of text to encode before a batch of results is handed on.
BATCH = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary strings and their ranks from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Bpe:
    """Encoder and decoder of a vocabulary of byte strings, whose ranks are both merge order and ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.strings = {i: b for b, i in ranks.items()}
        self.byte = [ranks[bytes([i])] for i in range(256)]
        #: Merge of two neighbouring symbols: left << 32 | right to rank, for each cut of each string.
        self.pairs = {
            ranks[b[:i]] << 32 | ranks[b[i:]]: r for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks
        }
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0
        self.awkward = re.compile(r" \s| $")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        rank, byte, n = self.pairs.get, self.byte, len(piece)
        symbol = [byte[c] for c in piece]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            a, j = symbol[i], right[i]
            if a < 0 or j >= n or rank(a << 32 | symbol[j]) != r:
                continue  # stale: one of the two has been merged since
            symbol[i], symbol[j] = r, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (q := rank(r << 32 | symbol[k])) is not None:
                    heappush(heap, q << 32 | i)
            if (h := left[i]) >= 0 and (q := rank(symbol[h] << 32 | r)) is not None:
                heappush(heap, q << 32 | h)
        return [s for s in symbol if s >= 0]

    def _word(self, word: str) -> bytes:
        if (ids := self.before.get(word)) is not None:
            pass
        elif word[-1:] in (".", ",") and word[1:-1].isalpha() and (word[0] == " " or word[0].isalpha()):
            bare = word[:-1]
            ids = (self.known.get(bare) or self._word(bare)) + (self.known.get(word[-1]) or self._word(word[-1]))
        else:
            plain = word[1:].isalpha() and (word[0] == " " or word[0].isalpha())
            pieces = (word,) if plain else self.pattern.findall(word)
            ids = array("i", chain.from_iterable([self.merge(p.encode("utf-8")) for p in pieces])).tobytes()
        if len(word) > LONGEST:
            return ids
        if self.held >= REMEMBERED // 2:
            self.before, self.known, self.held = self.known, {}, 0
        self.known[word] = ids
        self.held += len(word) + len(ids) + ENTRY
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; an empty text has none.

        Pieces never reach across a space before a non-space, so words are
        encoded, and remembered, one by one with the space before them. Texts
        with other runs of white space at a space are split by the pattern as a whole.
        """
        if self.awkward.search(text):
            words = self.pattern.findall(text)
        else:
            first, *rest = text.split(" ")
            words = [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]
        known = self.known
        return np.frombuffer(b"".join([known.get(w) or self._word(w) for w in words]), dtype=np.int32)

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str = PATTERN) -> Bpe:
    """The vocabulary at ``path``, read once a worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def forget() -> None:
    """Drop what this worker has read and remembered; it is read again when needed."""
    _LOADED.clear()
    tokens.release()


ADDED = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` with ids, n_tokens and round_trip (whether decoding the ids gives the text again) for column ``text``.

    ``text`` itself is dropped. A null text has null in all three; an empty one
    has no ids. Equal texts have equal ids; texts are encoded whole, whatever
    their length. Extra columns stay, but those of the added names are replaced.
    An empty table gives an empty one.
    The vocabulary's path must be readable on every executor.
    """
    names = {f.name for f in ADDED}
    kept = [f for f in docs.schema.fields if f.name not in names and f.name != text]
    schema = T.StructType(kept + ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts, start = batch.column(batch.schema.get_field_index(text)), 0
            while start < batch.num_rows:
                stop, size, ids, counts, same = start, 0, [], [], []
                while stop < batch.num_rows and size < BATCH:
                    t = texts[stop].as_py()
                    found = None if t is None else bpe.encode(t)
                    ids.append(found)
                    counts.append(None if found is None else len(found))
                    same.append(None if found is None else bpe.decode(found.tolist()) == t)
                    size += len(t or "")
                    stop += 1
                flat = np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]])
                ends = np.cumsum([0, *[0 if x is None else len(x) for x in ids]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in ids]))
                columns = [batch.column(batch.schema.get_field_index(f.name)).slice(start, stop - start) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(counts, pa.int32()), pa.array(same, pa.bool_())], names=schema.names)
                start = stop

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], text).mapInArrow(tokens.tidy(run), schema)


def decode(coded: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """``coded`` with column ``text`` decoded from ``ids``, which is dropped; null ids give null. An unknown id is an error."""
    kept = [f for f in coded.schema.fields if f.name not in (ids, "text")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([None if x is None else bpe.decode(x) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], texts], names=schema.names)

    return coded.select(*[F.col(f"`{f.name}`") for f in kept], ids).mapInArrow(tokens.tidy(run), schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    return encode(documents(spark, sf_dir).select("doc_id", "text"))
