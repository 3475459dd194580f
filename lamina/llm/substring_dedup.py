"""Substring dedup: suffix automata of reference shards, and documents streamed through them.

A span is a run of SPAN or more words. It is removed from a document if each
of its SPAN-word windows is also in a document of a smaller doc_id; so the
first document keeps the passage.

Exact copies of a text are told by 96 bits of hashes: all but the first are
repeated as a whole. The other texts go through these steps:

1. Winnowed fingerprints: of PRINT-word hashes, the least in each window of
   SPAN - PRINT + 1 is taken. So two equal passages of SPAN words share one,
   and those in one document only rule out most of the corpus.
2. Around fingerprints of several documents, the hashes of whole SPAN-word
   windows tell each repeated window's first document, its owner. Runs of owned
   windows are the reference, in which every repeated passage stands once.
3. Reference passages are cut into shards of about SHARD words. A suffix
   automaton of each goes to all tasks that hold documents for it, and
   documents are streamed through the shards that share a fingerprint with
   them; matching statistics of SPAN or more give the maximal spans, less the
   windows that a document owns.

Only regions around repeated fingerprints take part from step 2, so the work
follows the repeated text. Nothing is broadcast that grows with the corpus,
unless it is counted first; what is large meets by shuffles at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm import tokens
from lamina.llm.common import cut, documents, drop, if_small

#: Words in the shortest span that is removed, and in a fingerprint.
SPAN, PRINT = 50, 25
#: Words in a shard of the reference, and words streamed through one copy of its automaton.
SHARD, STREAM = 400_000, 2_000_000
#: Rows of marks, a few dozen bytes each, that may be broadcast.
MARKS = 100_000


def prints(h: np.ndarray, span: int, size: int) -> np.ndarray:
    """The winnowed fingerprint at each word, else 0; there are none in texts shorter than ``span``."""
    if len(h) < span:
        return np.zeros(0, dtype=np.uint64)
    g = tokens.grams(h, size) | np.uint64(1)
    window, least, have = span - size + 1, g, 1
    while have * 2 <= window:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < window:
        more = window - have
        least = np.minimum(least[: len(least) - more], least[more:])
    chosen = np.unique(least)
    at = np.minimum(np.searchsorted(chosen, g), len(chosen) - 1)
    return np.where(chosen[at] == g, g, np.uint64(0))


def windows(h: np.ndarray, span: int) -> np.ndarray:
    """Hash of each run of ``span`` words."""
    up, down = tokens._powers(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(tokens.mix(h) * up[: len(h)], out=total[1:], dtype=np.uint64)
    n = len(h) - span + 1
    return tokens.mix((total[span:] - total[:n]) * down[:n]) if n > 0 else total[:0]


class Automaton:
    """Suffix automaton of sequences, which are kept apart."""

    def __init__(self, sequences):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for apart, sequence in enumerate(sequences):
            for c in [*sequence, -1 - apart]:  # hashes are not negative here
                now = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = now
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    if length[q] == length[p] + 1:
                        link[now] = q
                    else:
                        clone = len(nxt)
                        nxt.append(nxt[q].copy())
                        length.append(length[p] + 1)
                        link.append(link[q])
                        while p >= 0 and nxt[p].get(c) == q:
                            nxt[p][c] = clone
                            p = link[p]
                        link[q] = link[now] = clone
                last = now

    def ends(self, sequence, least: int) -> list[int]:
        """Positions at which a match of ``least`` or more symbols ends: the matching statistics' test."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        found = []
        for i, c in enumerate(sequence):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(c)
            if to is None:
                n = 0
            else:
                v, n = to, n + 1
                if n >= least:
                    found.append(i)
        return found


def _runs(positions: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    if not len(positions):
        return []
    edge = np.flatnonzero(np.diff(positions) > 1)
    return list(zip(positions[np.append(0, edge + 1)].tolist(), positions[np.append(edge, len(positions) - 1)].tolist()))


def _hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    for _, run in tokens.chunks(texts):
        h, _, _, at, _ = tokens.split(run)
        for i in range(len(run)):
            yield h[at[i] : at[i + 1]]


def _as_rows(columns: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def _words(row: pa.ListScalar) -> np.ndarray:
    return row.values.to_numpy().view(np.uint64)


def _order() -> Column:
    """Order of documents; null doc_ids are last, as one document."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def _prints(keyed: DataFrame, span: int, size: int, columns: list[str]) -> DataFrame:
    """(print, *columns) for each different fingerprint of each row; keyed ends in text or words."""
    schema = "print long, " + ", ".join(f"{c} {t}" for c, t in keyed.dtypes if c in columns)
    names = ["print", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            rows = _hashes(last.to_pylist()) if pa.types.is_string(last.type) else (_words(x) for x in last)
            found, count = [], np.zeros(batch.num_rows, dtype=np.int64)
            for i, h in enumerate(rows):
                p = np.unique(prints(h, span, size))
                p = p[p > 0]
                count[i] = len(p)
                found.append(p.view(np.int64))
            if found:
                owner = pa.array(np.repeat(np.arange(batch.num_rows), count))
                own = [batch.column(batch.schema.get_field_index(c)).take(owner) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *own], names=names)

    return keyed.mapInArrow(tokens.tidy(run), schema)


def _regions(marked: DataFrame, span: int, size: int) -> DataFrame:
    """(id, hash, start, words): runs of words that windows around marked fingerprints cover. marked: id, hash, prints, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], []]
            for i, h in enumerate(_hashes(batch.column(3).to_pylist())):
                marks = np.sort(_words(batch.column(2)[i]))
                own = prints(h, span, size)
                at = np.minimum(np.searchsorted(marks, own), len(marks) - 1)
                hit = np.flatnonzero((marks[at] == own) & (own > 0))
                change = np.zeros(len(h) + 2, dtype=np.int64)
                np.add.at(change, np.maximum(hit - (span - size), 0), 1)
                np.add.at(change, np.minimum(hit, len(h) - span) + 1, -1)
                for a, b in _runs(np.flatnonzero(np.cumsum(change) > 0)):
                    for column, x in zip(out, (ids[i], hashes[i], a, h[a : b + span])):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out[:3]], _lists(out[3])], names=["id", "hash", "start", "words"])

    return marked.mapInArrow(tokens.tidy(run), "id long, hash long, start long, words array<long>")


def _windows(regions: DataFrame, span: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [windows(_words(x), span) for x in batch.column(1)]
            ids = np.repeat(batch.column(0).to_numpy(), list(map(len, w)))
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(w).view(np.int64)), pa.array(ids)], names=["window", "id"])

    return regions.select("id", "words").mapInArrow(tokens.tidy(run), "window long, id long")


def _owned(regions: DataFrame, first: DataFrame, span: int) -> DataFrame:
    """``regions`` with ``owned``, a bit for each window, set if this document is the first that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for i in range(batch.num_rows):
                w = windows(_words(batch.column(3)[i]), span)
                own = batch.column(4)[i]
                if own.is_valid:
                    own = np.sort(_words(own))
                    hit = own[np.minimum(np.searchsorted(own, w), len(own) - 1)] == w
                else:
                    hit = np.zeros(len(w), dtype=bool)
                bits.append(np.packbits(hit, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bits, pa.binary())], names=["id", "hash", "start", "words", "owned"])

    joined = regions.join(first.hint("shuffle_hash"), "id", "left").select("id", "hash", "start", "words", "first")
    return joined.mapInArrow(tokens.tidy(run), "id long, hash long, start long, words array<long>, owned binary")


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=n, bitorder="little").astype(bool)


def _passages(regions: DataFrame, span: int) -> DataFrame:
    """(id, words): runs of windows that their document owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i in range(batch.num_rows):
                h = _words(batch.column(1)[i])
                for a, b in _runs(np.flatnonzero(_bits(batch.column(2)[i].as_py(), len(h) - span + 1))):
                    ids.append(batch.column(0)[i].as_py())
                    out.append(h[a : b + span])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(out)], names=["id", "words"])

    return regions.select("id", "words", "owned").mapInArrow(tokens.tidy(run), "id long, words array<long>")


def _whole(copies: DataFrame, span: int) -> DataFrame:
    """(id, hash, from, to) that span the whole text, of texts of ``span`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.fromiter(map(len, _hashes(batch.column(2).to_pylist())), dtype=np.int64, count=batch.num_rows)
            keep = pa.array(n >= span)
            found = [batch.column(0), batch.column(1), pa.array(np.zeros(len(n), dtype=np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in found], names=["id", "hash", "from", "to"])

    return copies.select("id", "hash", "text").mapInArrow(tokens.tidy(run), "id long, hash long, `from` long, `to` long")


def spans(docs: DataFrame, span: int = SPAN, size: int = PRINT) -> DataFrame:
    """(id, hash, spans): word ranges [from, to) to remove from the texts of that order and hash."""
    keyed = docs.filter("text is not null").select(_order().alias("id"), F.xxhash64("text").alias("hash"), F.crc32("text").alias("crc"), "text")
    several = keyed.groupBy("hash", "crc").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("hash", "crc", "lo")
    several = if_small(cut(several), MARKS)
    known = keyed.join(several, ["hash", "crc"], "left")
    keyed = known.filter("lo is null or id = lo").select("id", "hash", "text")
    copies = known.filter("id > lo")

    by_print = Window.partitionBy("print")
    found = _prints(keyed, span, size, ["id", "hash"])
    found = found.withColumns({"lo": F.min("id").over(by_print), "hi": F.max("id").over(by_print)}).filter("lo < hi")
    marks = cut(found.groupBy("id", "hash").agg(F.collect_list("print").alias("prints")))
    marked = keyed.join(if_small(marks, MARKS, 8 * F.size("prints")), ["id", "hash"])
    bare = cut(_regions(marked.select("id", "hash", "prints", "text"), span, size))
    drop(marks)

    window = _windows(bare, span).groupBy("window").agg(F.min("id").alias("id"), F.max("id").alias("hi")).filter("id < hi")
    first = window.groupBy("id").agg(F.collect_list("window").alias("first"))
    regions = cut(_owned(bare, first, span))
    drop(bare)
    passages = cut(_passages(regions, span))
    words = passages.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-words // SHARD))
    passages = passages.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)))

    there = _prints(passages.select("id", "shard", "words"), span, size, ["id", "shard"]).groupBy("print", "shard").agg(F.min("id").alias("least"))
    here = _prints(regions.select("id", "hash", "start", "words"), span, size, ["id", "hash", "start"])
    route = cut(here.join(there, "print").filter("least < id").select("id", "hash", "start", "shard").distinct())
    stream = regions.join(if_small(route, 3 * MARKS), ["id", "hash", "start"])
    # A row a shard.
    load = if_small(cut(stream.groupBy("shard").agg(F.ceil(F.sum(F.size("words")) / STREAM).alias("parts"))))
    stream = stream.join(load, "shard").select(
        "shard", F.pmod(F.xxhash64("id", "start"), F.col("parts")).alias("part"), "id", "hash", "start", "words", "owned"
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p")
    reference = passages.join(load, "shard").select(F.col("shard").alias("s"), every, F.col("words").alias("passage"))

    def match(key, rows: pd.DataFrame, reference: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(reference):
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("id", "hash", "from", "to")})
        # Less their top bit, hashes are not negative; separators are.
        low = np.int64((1 << 63) - 1)
        automaton = Automaton([(np.asarray(p, dtype=np.int64) & low).tolist() for p in reference["passage"]])
        out: list[list] = [[], [], [], []]
        for i, h, start, w, owned in zip(rows["id"], rows["hash"], rows["start"], rows["words"], rows["owned"]):
            w = np.asarray(w, dtype=np.int64)
            begins = np.array(automaton.ends((w & low).tolist(), span), dtype=np.int64) - span + 1
            begins = begins[~_bits(owned, len(w) - span + 1)[begins]]
            for a, b in _runs(begins):
                for column, x in zip(out, (i, h, start + a, start + b + span)):
                    column.append(x)
        return pd.DataFrame(dict(zip(("id", "hash", "from", "to"), out)))

    matched = stream.groupBy("shard", "part").cogroup(reference.groupBy("s", "p")).applyInPandas(match, "id long, hash long, `from` long, `to` long")
    return (
        matched.unionByName(_whole(copies, span)).groupBy("id", "hash").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"))
    )


def remove(text: str, ranges: list[tuple[int, int]]) -> str:
    """``text`` without the words of the ranges and the white space after each range."""
    raw = text.encode("utf-8", "surrogatepass")
    _, start, _, _, _ = tokens.split([raw])
    begins = np.append(start, len(raw))
    kept, at = [], 0
    for a, b in ranges:
        if begins[b] > at:
            kept.append(raw[at : max(at, begins[a])])
            at = begins[b]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def substring_dedup(docs: DataFrame, span: int = SPAN, size: int = PRINT) -> DataFrame:
    """``docs`` with repeated spans gone from ``text``, and ``removed_words``, how many words went.

    Rows and other columns stay; a column named removed_words is replaced. Words
    are cut at ASCII white space; case counts. Rows that share a doc_id are one
    document, as are rows of a null doc_id, which come last: what only they
    share stays. Null texts stay null, and texts of fewer than ``span`` words
    stay as they are. A text that is all repeated is empty afterwards.
    """
    docs = docs.drop("removed_words")
    found = cut(spans(docs, span, size))
    marks = if_small(found, MARKS, 16 * F.size("spans")).select(F.col("id").alias("__lamina_id"), F.col("hash").alias("__lamina_hash"), F.col("spans").alias("__lamina_spans"))
    marked = docs.withColumns({"__lamina_o": _order(), "__lamina_h": F.xxhash64("text")})
    marked = marked.join(marks, (F.col("__lamina_o") == F.col("__lamina_id")) & (F.col("__lamina_h") == F.col("__lamina_hash")), "left")

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else remove(t, [(r["from"], r["to"]) for r in rs]) for t, rs in zip(text, ranges)], dtype=object)

    hit = F.col("__lamina_spans").isNotNull()
    text = F.when(hit, cleaned(F.when(hit, F.col("text")), "__lamina_spans")).otherwise(F.col("text"))
    # Spans of one document are sorted but may overlap where they came from two shards.
    far = F.aggregate(
        "__lamina_spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["from"], s["to"]))).alias("n"), F.greatest(s["to"], x["to"]).alias("to")
        ),
    )["n"]
    return marked.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.coalesce(far, F.lit(0)).alias("removed_words"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the spans of SPAN words or more that an earlier document has."""
    return substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
