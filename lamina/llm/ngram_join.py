"""Exact n-gram Jaccard join by token-combination prefixes.

A document is its set of word n-grams (64-bit hashes). Two sets of Jaccard
similarity THETA or more share at least t = ceil(THETA * size) n-grams, whatever
the partner. All n-grams have one order: by how many different texts have them
(in powers of 2), then by hash. So a set's prefix takes its rarest first:

- n-grams of a single text can't be shared. They fill the prefix and are never
  indexed. A set that has size - t + 1 of them has no partner and goes no
  further, which is most of a corpus.
- Rare ones are indexed singly and, within each class of frequent ones,
  combinations of k. A combination is lost already when all but k - 1 of its
  class are, so the prefix is extended until

      single + rare + sum over groups of (n-grams in the group - k + 1)  >=  size - t + 1:

then no partner can miss every signature. Of two similar sets, the one whose
prefix ends first in the order has all its prefix's shared n-grams in the
other's prefix, so both have the shared signature. Groups are hash buckets
inside a class, as many as suit the size: they keep the combinations few.
Since partners' sizes differ by 1 / THETA at most, each set is indexed for its
own power of 2 and for the next ones as far as that, and pairs meet at the larger
one's.

The counts are exact and cost one round trip of about 4 bytes an n-gram. Equal
texts are told first and count once. The others are read in lots of LOT n-grams;
a lot sends its sorted keys (the first bits of the hashes), as differences, to
ranges of keys, and each range sends back those that several texts have. Keys
that agree by chance only make an n-gram seem less rare. An n-gram of more than
LOCAL texts of a lot is sent once for all of them, so none is too hot for a range.

Candidates first meet by their parity bitmaps, which bound the similarity from
above at a small part of a text's bytes; texts move for those that are left.

Where groups and numbers of links are asked for, and not the pairs themselves, a
list of sets of one signature only gives the pairs of its least set with the
others. Those that are similar join to clusters. Inside a cluster all links are
counted at once, by products of blocks of its sets, and no pair is spelled out;
only pairs of a list that are in different clusters are candidates for
themselves. So a cluster of m near copies costs m candidates instead of their
square.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import tokens
from lamina.llm.common import cut, documents, drop, if_small

#: Words in an n-gram, and least Jaccard similarity, which is below that of edited copies. THETA must be LEAST at least: below, what groups lose could exceed a set's need.
N, THETA, LEAST = 3, 0.5, 0.4
#: (least number of texts, a power of 2; k): the classes of frequent n-grams.
CLASSES = [(64, 2), (4096, 3)]
#: n-grams of a lot and of a range of keys; texts of a lot with the same key from which it is sent once for all.
LOT, RANGE, LOCAL = 1 << 21, 1 << 20, 16
#: Bits of a key beyond those that number all n-grams: one in 2**SPARE keys agrees with another by chance. And bits of a key at least and at most.
SPARE, KEY = 10, (36, 48)
#: Pairs to verify in one piece, and members of a list that are paired at once.
PIECE, BLOCK = 200_000, 512
#: n-grams and sets of a cluster's block at most, about; columns of a product at once; how many times a column's pairs must fit in a product to be counted one by one.
GRAMS, MEMBERS, TILE, SPARSE = 1 << 19, 2000, 1024, 64
#: Pairs of one set that are verified in one piece.
STAR = 500
#: Largest power of 2 of a size at which every n-gram is indexed singly.
SINGLY = 4
#: Texts of a lot at most; the number after the last stands for several.
_MANY = 0xFFFF


def gram_sets(texts: list[str | None], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct n-gram hashes) of each text; none for nulls and texts without words."""
    for first, run in tokens.chunks(texts):
        h, _, _, at, _ = tokens.split(run)
        for i in range(len(run)):
            yield first + i, np.unique(tokens.grams(h[at[i] : at[i + 1]], n))


def identity(grams: np.ndarray) -> tuple[int, int]:
    """Twice 64 bits that stand for a set of n-grams."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.add.reduce(tokens.mix(grams ^ np.uint64(salt)), keepdims=True)
        out.append(int(tokens.mix(total + np.uint64(len(grams))).view(np.int64)[0]))
    return out[0], out[1]


def parity(grams: np.ndarray) -> bytes:
    """A bitmap as wide as the power of 2 from the set's size: bit i is the number of n-grams whose hash is i modulo the width, modulo 2."""
    width = max(64, 1 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


@lru_cache(maxsize=256)
def _choose(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(-1, k)


def _needed(size: int, theta: float) -> int:
    return size - math.ceil(theta * size - 1e-9) + 1


def signatures(keys: np.ndarray, levels: np.ndarray, size: int, theta: float) -> np.ndarray:
    """Signatures of a set of ``size`` n-grams, from the keys of those that several texts have, in their order.

    ``levels``: the power of 2 of the number of texts.
    """
    need = _needed(size, theta) - (size - len(keys))
    if need <= 0:
        return keys[:0]
    kind = np.searchsorted([least.bit_length() - 1 for least, _ in CLASSES], levels, side="right")
    rare = int((kind == 0).sum())
    if rare >= need:
        return np.unique(keys[:need])
    found = []
    own = size.bit_length() - 1
    for power in range(own, own + 1 + math.ceil(math.log2(1 / theta) - 1e-9)):
        if power <= SINGLY:
            found.append(keys[:need])
            continue
        groups = max(1, (1 << power) // 32)
        # A group's first k - 1 n-grams in the prefix don't count towards the need.
        group = kind.astype(np.int64) * groups + (tokens.mix(keys) % np.uint64(groups)).astype(np.int64)
        nth = np.zeros(len(keys), dtype=np.int64)
        by = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[by], prepend=-1))
        nth[by] = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
        counts = (kind == 0) | (nth >= np.array([0, *[k - 1 for _, k in CLASSES]])[kind])
        length = int(np.searchsorted(np.cumsum(counts), need)) + 1
        assert length <= len(keys), "a prefix can't reach its need"
        found.append(keys[:rare])
        part, tail = group[rare:length], keys[rare:length]
        by = np.argsort(part, kind="stable")
        part, tail = part[by], tail[by]
        edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        for a, b in zip(edges[:-1], edges[1:]):
            k = CLASSES[part[a] // groups - 1][1]
            if b - a >= k:
                picks = np.sort(tail[a:b])[_choose(int(b - a), k)]
                sig = np.full(len(picks), power * 8 + k, dtype=np.uint64)
                for c in range(k):
                    sig = tokens.mix(sig + picks[:, c])
                found.append(sig)
    return np.unique(np.concatenate(found))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, byte by byte without the bytes that none needs."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head.append(struct.pack("<QBB", len(a), width, a.itemsize))
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T).tobytes())
    return b"".join([*head, pa.compress(b"".join(body), codec="zstd", asbytes=True)])


def _unpack(blob: bytes) -> list[np.ndarray]:
    heads = [struct.unpack_from("<QBB", blob, 1 + 10 * i) for i in range(blob[0])]
    raw = np.frombuffer(pa.decompress(blob[1 + 10 * blob[0] :], sum(n * w for n, w, _ in heads), codec="zstd", asbytes=True), dtype=np.uint8)
    out, at = [], 0
    for n, width, item in heads:
        a = np.zeros((n, item), dtype=np.uint8)
        a[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(a.reshape(-1).view(f"<u{item}"))
        at += n * width
    return out


def _edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.append(np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])[: len(sorted_keys)]), len(sorted_keys))


def _low(part: int, bits: int, ranges: int) -> np.uint64:
    """The least key of a range."""
    return np.uint64((part << bits) // ranges)


def _lot(sets: list[np.ndarray], ids: list[int], bits: int, ranges: int) -> Iterator[tuple[int, bytes]]:
    """(-1, the lot's header) and (range, blob) of its keys with the texts that have them."""
    size = np.fromiter(map(len, sets), dtype=np.uint32, count=len(sets))
    packed = np.concatenate(sets) >> np.uint64(64 - bits)
    packed = np.sort(packed << np.uint64(16) | np.repeat(np.arange(len(sets), dtype=np.uint64), size))
    key, text = packed >> np.uint64(16), (packed & np.uint64(_MANY)).astype(np.uint16)
    edge = _edges(key)
    count = np.diff(edge)
    hot = count > LOCAL
    inside = np.repeat(hot, count)
    yield -1, _pack(np.array(ids, dtype=np.int64).view(np.uint64), size, key[edge[:-1]][hot], count[hot].astype(np.uint32), text[inside])
    keep = ~inside
    keep[edge[:-1][hot]] = True
    text[inside] = _MANY
    key, text = key[keep], text[keep]
    weight, nth = count[hot].astype(np.uint32), np.append(0, np.cumsum(text == _MANY))
    low = np.array([_low(r, bits, ranges) for r in range(ranges + 1)])
    at = np.searchsorted(key, low)
    for r in range(ranges):
        a, b = at[r], at[r + 1]
        if b > a:
            yield r, _pack(np.diff(key[a:b], prepend=low[r]), text[a:b], weight[nth[a] : nth[b]])


def _scan(texts: DataFrame, n: int, bits: int, ranges: int) -> DataFrame:
    """A row for each text that has words (part -2: h, c, set, check, size, bits), and each lot's rows (part, lot, blob). texts: h, c, text."""
    columns = ["part", "lot", "h", "c", "set", "check", "size", "bits", "blob"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lot = TaskContext.get().partitionId() << 32
        sets, ids, total = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal sets, ids, total, lot
            rows = []
            for part, blob in _lot(sets, ids, bits, ranges):
                rows.append((part, lot, None, None, None, None, None, None, blob))
                if len(rows) == 256:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)
            sets, ids, total, lot = [], [], 0, lot + 1

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                h, c, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
                for i, g in gram_sets(batch.column(2).to_pylist(), n):
                    if not len(g):
                        continue
                    name, check = identity(g)
                    rows.append((-2, None, h[i], c[i], name, check, len(g), parity(g), None))
                    if sets and (total + len(g) > LOT or len(sets) == _MANY):
                        yield from close()
                    sets.append(g)
                    ids.append(name)
                    total += len(g)
                if rows:
                    yield table(rows)
        if sets:
            yield from close()

    return texts.mapInArrow(tokens.tidy(run), "part int, lot long, h long, c long, set long, check long, size int, bits binary, blob binary")


def _counted(table: pa.Table, bits: int, ranges: int) -> pa.Table:
    """Of one range's blobs: each lot's keys that several texts have, with the power of 2 of how many."""
    keys, texts, weights = [], [], []
    low = _low(table.column("part")[0].as_py(), bits, ranges)
    for blob in table.column("blob"):
        step, text, weight = _unpack(blob.as_py())
        keys.append(low + np.cumsum(step, dtype=np.uint64))
        texts.append(text)
        w = np.ones(len(text), dtype=np.int64)
        w[text == _MANY] = weight
        weights.append(w)
    key = np.concatenate(keys)
    by = np.argsort(key)
    edge = _edges(key[by])
    count = np.add.reduceat(np.concatenate(weights)[by], edge[:-1])
    level = np.zeros(len(key), dtype=np.uint8)
    level[by] = np.repeat((np.frexp(count.astype(np.float64))[1] - 1).astype(np.uint8), np.diff(edge))
    blobs, at = [], 0
    for k, t in zip(keys, texts):
        own = level[at : at + len(k)]
        at += len(k)
        keep = own > 0
        blobs.append(_pack(np.diff(k[keep], prepend=low), t[keep], own[keep]))
    tokens.release()
    return pa.table([table.column("part"), table.column("lot"), pa.array(blobs, pa.binary())], names=["part", "lot", "blob"])


def _signed(table: pa.Table, theta: float, bits: int, ranges: int) -> pa.Table:
    """(sig, set, size) of one lot's texts that may have partners, from its header and what the ranges sent back."""
    keys, texts, levels = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)]
    for part, blob in zip(table.column("part").to_pylist(), table.column("blob")):
        found = _unpack(blob.as_py())
        if part < 0:
            ids, sizes, hot, count, members = found
        else:
            keys.append(_low(part, bits, ranges) + np.cumsum(found[0], dtype=np.uint64))
            texts.append(found[1])
            levels.append(found[2])
    key, text, level = np.concatenate(keys), np.concatenate(texts), np.concatenate(levels)
    many = text == _MANY
    if many.any():
        # Every key of several texts of a lot comes back, and hot is sorted.
        own = np.argsort(key[many])
        level = np.concatenate([level[~many], np.repeat(level[many][own], count)])
        key = np.concatenate([key[~many], np.repeat(hot, count)])
        text = np.concatenate([text[~many], members])
    by = np.lexsort((key, level, text))
    key, level = key[by], level[by]
    ends = np.searchsorted(text[by], np.arange(len(sizes) + 1))
    sigs, owner, size = [np.zeros(0, np.uint64)], [], []
    for i in range(len(sizes)):
        a, b = ends[i], ends[i + 1]
        s = signatures(key[a:b], level[a:b], int(sizes[i]), theta)
        if len(s):
            sigs.append(s)
            owner.append(np.full(len(s), ids[i]))
            size.append(np.full(len(s), sizes[i], dtype=np.int32))
    tokens.release()
    owner, size = np.concatenate([np.zeros(0, np.uint64), *owner]), np.concatenate([np.zeros(0, np.int32), *size])
    return pa.table([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(owner.view(np.int64)), pa.array(size)], names=["sig", "set", "size"])


def _index(scan: DataFrame, theta: float, bits: int, ranges: int) -> DataFrame:
    """(sig, set, size): a row for each signature of each text that may have a partner."""
    blobs = scan.filter("part >= 0").select("part", "lot", "blob")
    back = blobs.groupBy("part").applyInArrow(lambda table: _counted(table, bits, ranges), "part int, lot long, blob binary")
    lots = back.unionByName(scan.filter("part = -1").select("part", "lot", "blob"))
    return lots.groupBy("lot").applyInArrow(lambda table: _signed(table, theta, bits, ranges), "sig long, set long, size int")


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of an equal first column, from batches that are sorted by it."""
    held: list[list[np.ndarray]] = []

    def together() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held)]

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held and held[0][0][0] != now[0][0]:
            yield together()
            held = []
        last = int(np.searchsorted(now[0], now[0][-1]))
        if last:
            held.append([c[:last] for c in now])
            yield together()
            held = []
        held.append([c[last:] for c in now])
    if held:
        yield together()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(least, split, sets, sizes) for each signature of several sets; equal sets count once.

    A list of more than BLOCK sets becomes lists of two of its blocks each, of
    which only those before and after ``split`` are to meet; sets are in the
    same blocks in all lists of like length. ``least`` is alike for the lists of
    one group of similar sets, mostly.
    """
    for sig, ident, size in _sorted_runs(batches):
        order = np.lexsort((ident, sig))
        sig, ident, size = sig[order], ident[order], size[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (ident[1:] != ident[:-1]))
        sig, ident, size = sig[new], ident[new], size[new]
        edge = _edges(sig)
        count = np.diff(edge)
        short = (count > 1) & (count <= BLOCK)
        keep = np.repeat(short, count)
        if keep.any():
            ends = np.append(0, np.cumsum(count[short])).astype(np.int32)
            some, sizes = ident[keep], size[keep]
            for a in range(0, len(ends) - 1, 50_000):
                e = ends[a : a + 50_001]
                yield _rows(some[e[:-1]], np.zeros(len(e) - 1, np.int32), e - e[0], some[e[0] : e[-1]], sizes[e[0] : e[-1]])
        for i in np.flatnonzero(count > BLOCK):
            own, sizes = ident[edge[i] : edge[i + 1]], size[edge[i] : edge[i + 1]]
            blocks = 1 << (len(own) // BLOCK).bit_length()
            home = (tokens.mix(own.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            members = [np.flatnonzero(home == b) for b in range(blocks)]
            for a in range(blocks):
                for b in range(a, blocks):
                    at = np.concatenate([members[a], members[b]]) if b > a else members[a]
                    split = len(members[a]) if b > a else 0
                    if len(at) > max(1, split) and (split or a == b):
                        name = tokens.mix(tokens.mix(own[:1].view(np.uint64)) + np.uint64(a * blocks + b + 1)).view(np.int64)
                        yield _rows(name, np.array([split], np.int32), np.array([0, len(at)]), own[at], sizes[at])


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_lists``, but none is split, and the sets of each are in order."""
    for sig, ident, size in _sorted_runs(batches):
        order = np.lexsort((ident, sig))
        sig, ident, size = sig[order], ident[order], size[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (ident[1:] != ident[:-1]))
        sig, ident, size = sig[new], ident[new], size[new]
        count = np.diff(_edges(sig))
        keep = np.repeat(count > 1, count)
        ends = np.append(0, np.cumsum(count[count > 1]))
        some, sizes = ident[keep], size[keep]
        for a in range(0, len(ends) - 1, 50_000):
            e = ends[a : a + 50_001]
            yield _rows(some[e[:-1]], np.zeros(len(e) - 1, np.int32), e - e[0], some[e[0] : e[-1]], sizes[e[0] : e[-1]])


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists, sorted by their least set, each once: most of a group's signatures have the same sets."""

    def flush() -> pa.RecordBatch:
        ends = np.append(0, np.cumsum([len(x) for _, x, _ in out]))
        return _rows(np.array([k for k, _, _ in out]), np.zeros(len(out), np.int32), ends, np.concatenate([x for _, x, _ in out]), np.concatenate([s for _, _, s in out]))

    out, held = [], 0
    for least, lists in _whole_groups(batches):
        for x, s in {x.tobytes(): (x, s) for _, x, s in lists}.values():
            out.append((least, x, s))
            held += len(x)
            if held > 100_000:
                yield flush()
                out, held = [], 0
    if out:
        yield flush()


def _rows(least: np.ndarray, split: np.ndarray, ends: np.ndarray, sets: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(ends.astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(sets)), pa.ListArray.from_arrays(ends, pa.array(sizes.astype(np.int32)))]
    return pa.RecordBatch.from_arrays([pa.array(least), pa.array(split), *lists], names=["least", "split", "sets", "sizes"])


def _pairs_of(lists: list[tuple[int, np.ndarray, np.ndarray]], theta: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs (a, b), a < b, of lists' members whose sizes allow theta, some at a time."""
    if len(lists) == 1 and len(lists[0][1]) == 2:
        _, (a, b), (m, n) = lists[0]
        if min(m, n) >= theta * max(m, n):
            yield np.array([min(a, b)]), np.array([max(a, b)])
        return
    ids, first, inverse = np.unique(np.concatenate([x for _, x, _ in lists]), return_index=True, return_inverse=True)
    size = np.concatenate([s for _, _, s in lists])[first].astype(np.float64)
    ends = np.cumsum([0, *[len(x) for _, x, _ in lists]])
    # Rows of the matrix of who meets whom, as many at a time as 1 MB holds.
    step = max(1, (1 << 20) // len(ids))
    for start in range(0, len(ids), step):
        met = np.zeros((min(step, len(ids) - start), len(ids)), dtype=bool)
        for (split, _, _), a, b in zip(lists, ends[:-1], ends[1:]):
            local = inverse[a:b]
            for own, others in ((local[:split], local[split:]), (local[split:], local[:split])) if split else ((local, local),):
                own = own[(own >= start) & (own < start + len(met))]
                met[np.ix_(own - start, others)] = True
        a, b = np.nonzero(met)
        a += start
        near = (b > a) & (np.minimum(size[a], size[b]) >= theta * np.maximum(size[a], size[b]))
        if near.any():
            yield ids[a[near]], ids[b[near]]


def _candidates(lists: DataFrame, theta: float) -> DataFrame:
    """(least, piece, a, b). Lists of one least member meet in one task, so that a pair of many shared signatures comes out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["least", "piece", "a", "b"])

        for least, lists in _whole_groups(batches):
            made = 0
            for a, b in _pairs_of(lists, theta):
                out.append((np.full(len(a), least), np.full(len(a), made // PIECE), a, b))
                made += len(a)
                held += len(a)
                if held > 100_000:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return lists.repartition("least").sortWithinPartitions("least").mapInArrow(tokens.tidy(run), "least long, piece long, a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """(least, its lists), whole."""
    current, held = None, []
    for batch in batches:
        least, split = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(2), batch.column(3))]
        for i in range(len(least)):
            if held and current != least[i]:
                yield current, held
                held = []
            current = int(least[i])
            held.append((int(split[i]), *[values[offsets[i] : offsets[i + 1]] for offsets, values in parts]))
    if held:
        yield current, held


def possible(size_a: np.ndarray, size_b: np.ndarray, bits_a: list[bytes], bits_b: list[bytes], theta: float) -> np.ndarray:
    """Whether each pair of sets may reach ``theta``.

    Bits that differ are at most the n-grams that only one of the two has, and
    of similar sets those are at most (1 - theta) / (1 + theta) of both sizes.
    The wider bitmap is folded to the width of the other.
    """
    most = (1 - theta) / (1 + theta) * (size_a + size_b) + 1e-9
    keep = np.zeros(len(size_a), dtype=bool)
    width = np.minimum([len(x) for x in bits_a], [len(x) for x in bits_b])

    def folded(bits: list[bytes], w: int) -> np.ndarray:
        wide = [np.frombuffer(x, dtype=np.uint8) for x in bits]
        return np.stack([np.bitwise_xor.reduce(x.reshape(-1, w), axis=0) for x in wide])

    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        step = max(1, (4 << 20) // w)
        for i in range(0, len(own), step):
            at = own[i : i + step]
            apart = np.bitwise_count(folded([bits_a[j] for j in at], w) ^ folded([bits_b[j] for j in at], w))
            keep[at] = apart.sum(axis=1, dtype=np.int64) <= most[at]
    return keep


def _apart(labels: np.ndarray, sets: np.ndarray, sizes: np.ndarray, least: int, start: int, theta: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a < b, of a list's sets with different labels, without those of ``least``, some at a time. In the order of labels; of the BLOCK sets from ``start`` on with later ones."""
    n = len(sets)
    first = np.searchsorted(labels, labels[start : start + BLOCK], side="right")
    total = np.append(0, np.cumsum(n - first))
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 20), side="right")) - 1)
        count = n - first[at:stop]
        i = np.repeat(np.arange(start + at, start + stop), count)
        j = np.arange(len(i)) - np.repeat(np.append(0, np.cumsum(count))[:-1] - first[at:stop], count)
        near = np.minimum(sizes[i], sizes[j]) >= theta * np.maximum(sizes[i], sizes[j])
        near &= (sets[i] != least) & (sets[j] != least)
        a, b = sets[i[near]], sets[j[near]]
        yield np.minimum(a, b), np.maximum(a, b)
        at = stop


def _across(lists: DataFrame, labels: DataFrame, theta: float) -> DataFrame:
    """(least, piece, a, b): candidates of different clusters. lists: least, sets, sizes; those of a list's least set have been verified. labels: node, head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def flush() -> pa.RecordBatch:
            least, a, b = (np.concatenate(c).astype(np.int64) for c in zip(*out))
            by = np.lexsort((b, a))
            new = np.append(True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]))[: len(by)]
            by = by[new]
            return pa.RecordBatch.from_arrays([pa.array(least[by]), pa.array(np.zeros(len(by), np.int64)), pa.array(a[by]), pa.array(b[by])], names=["least", "piece", "a", "b"])

        for batch in batches:
            least, start = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            offsets = batch.column(2).offsets.to_numpy()
            label, sets, sizes = (c.values.to_numpy() for c in batch.columns[2:])
            for i in range(batch.num_rows):
                own = slice(offsets[i], offsets[i + 1])
                for a, b in _apart(label[own], sets[own], sizes[own].astype(np.float64), least[i], start[i], theta):
                    out.append((np.full(len(a), least[i]), a, b))
                    held += len(a)
                    if held > 1_000_000:
                        yield flush()
                        out, held = [], 0
        if out:
            yield flush()

    def named(lists: pa.Table, members: pa.Table) -> pa.Table:
        """A group's lists of several labels, in the order of labels."""
        if not len(lists):
            return empty
        sets, label = members.column("set").to_numpy(), members.column("label").to_numpy()
        by = np.argsort(sets)
        sets, label, out = sets[by], label[by], []
        for x, size in zip(lists.column("sets"), lists.column("sizes")):
            x, size = x.values.to_numpy(), size.values.to_numpy()
            own = label[np.searchsorted(sets, x)]
            order = np.lexsort((x, own))
            if own[order[0]] != own[order[-1]]:
                out.append((own[order], x[order], size[order]))
        if not out:
            return empty
        ends = pa.array(np.append(0, np.cumsum([len(x) for x, _, _ in out])).astype(np.int32))
        columns = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in zip(*out)]
        return pa.table([pa.array(np.full(len(out), lists.column("least")[0].as_py())), *columns], schema=empty.schema)

    many = pa.list_(pa.int64())
    empty = pa.schema([("least", pa.int64()), ("label", many), ("set", many), ("size", pa.list_(pa.int32()))]).empty_table()
    # A list of two has no other pair than that of its least set, and a group of one label has none.
    long = lists.filter(F.size("sets") > 2)
    members = long.select("least", F.explode("sets").alias("set")).distinct().join(if_small(labels), F.col("set") == F.col("node"), "left")
    members = cut(members.select("least", "set", F.coalesce("head", "set").alias("label")))
    mixed = cut(members.groupBy("least").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("least"))
    long, members = (x.join(if_small(mixed), "least", "left_semi") for x in (long.select("least", "sets", "sizes"), members))
    held = long.groupBy("least").cogroup(members.groupBy("least")).applyInArrow(named, "least long, label array<long>, set array<long>, size array<int>")
    parts = held.withColumn("start", F.explode(F.sequence(F.lit(0), F.expr(f"int((size(`set`) - 1) div {BLOCK})"))))
    flat = parts.select("least", (F.col("start") * BLOCK).alias("start"), "label", "set", "size")
    return flat.repartition("least", "start").sortWithinPartitions("least").mapInArrow(tokens.tidy(run), "least long, piece long, a long, b long")


def shared(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Number of n-grams that each of the sets ``a`` has in common with each of ``b``, or of ``a`` itself."""
    every = a if b is None else a + b
    n, m = len(a), len(a if b is None else b)
    size = np.fromiter(map(len, every), dtype=np.int64, count=len(every))
    _, column = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), size)
    split = int(size[:n].sum())
    left, right = ((row[:split], column[:split]),) * 2 if b is None else ((row[:split], column[:split]), (row[split:] - n, column[split:]))
    kinds = int(column.max()) + 1
    met = np.bincount(left[1], minlength=kinds) * np.bincount(right[1], minlength=kinds)
    # Of a single set, in a product with itself, only the set's own number with itself is less; it isn't asked for.
    met[met < (2 if b is None else 1)] = 0
    out = np.zeros((n, m), dtype=np.float32)
    dense = met * SPARSE > n * m
    number = np.cumsum(dense) - 1
    sides = [(r[dense[c]], number[c[dense[c]]]) for r, c in (left, right)]
    for at in range(0, int(dense.sum()), TILE):
        tiles = []
        for (r, c), rows in zip(sides, (n, m)):
            own = (c >= at) & (c < at + TILE)
            tile = np.zeros((rows, TILE), dtype=np.float32)
            tile[r[own], c[own] - at] = 1
            tiles.append(tile)
        out += tiles[0] @ tiles[1].T
    few = (met > 0) & ~dense
    (r, c), (s, d) = ((r[few[c]], c[few[c]]) for r, c in (left, right))
    by = np.argsort(d, kind="stable")
    s, d = s[by], d[by]
    begin = np.searchsorted(d, c)
    count = np.searchsorted(d, c, side="right") - begin
    total = np.append(0, np.cumsum(count))
    at = 0
    while at < len(c):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 22), side="right")) - 1)
        k = count[at:stop]
        j = np.arange(int(k.sum())) - np.repeat(total[at:stop] - total[at] - begin[at:stop], k)
        out += np.bincount(np.repeat(r[at:stop], k) * m + s[j], minlength=n * m).reshape(n, m)
        at = stop
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, theta: float) -> np.ndarray:
    """Whether each of the sets ``a`` reaches ``theta`` with each of ``b``, or with the others of ``a``."""
    both = shared(a, b).astype(np.float64)
    size = np.array([len(x) for x in a], dtype=np.float64)
    other = size if b is None else np.array([len(x) for x in b], dtype=np.float64)
    out = both / (size[:, None] + other[None, :] - both) >= theta
    if b is None:
        np.fill_diagonal(out, False)
    return out


def _inside(texts: DataFrame, meta: DataFrame, held: DataFrame, labels: DataFrame, n: int, theta: float) -> DataFrame:
    """(set, more): how many documents of its cluster's other sets each set is linked to. held: set, docs. labels: node, head."""

    def count(table: pa.Table) -> pa.Table:
        label, lo, hi, block = (table.column(x).to_numpy() for x in ("label", "lo", "hi", "block"))
        docs, names = table.column("docs").to_numpy().astype(np.float64), table.column("set").to_numpy()
        by = np.lexsort((block, hi, lo, label))
        new = np.append(True, (np.diff(label[by]) != 0) | (np.diff(lo[by]) != 0) | (np.diff(hi[by]) != 0))
        edge = np.append(np.flatnonzero(new), len(by))
        text, sets, more = table.column("text"), [], []
        for s, e in zip(edge[:-1], edge[1:]):
            own = by[s:e]
            first = own[block[own] == lo[own]] if lo[own[0]] < hi[own[0]] else own
            second = own[len(first) :]
            if len(own) < 2 or lo[own[0]] < hi[own[0]] and not (len(first) and len(second)):
                continue
            grams = [g for _, g in gram_sets([text[int(i)].as_py() for i in own], n)]
            met = linked(grams[: len(first)], grams[len(first) :] or None, theta)
            sets.append(names[first])
            more.append(met @ docs[own[len(first) :] if len(second) else first])
            if len(second):
                sets.append(names[second])
                more.append(met.T @ docs[first])
        tokens.release()
        if not sets:
            return pa.table([pa.array([], pa.int64())] * 2, names=["set", "more"])
        return pa.table([pa.array(np.concatenate(sets)), pa.array(np.concatenate(more).astype(np.int64))], names=["set", "more"])

    every = labels.select(F.col("node").alias("set"), F.col("head").alias("label")).unionByName(labels.select(F.col("head").alias("set"), F.col("head").alias("label")).distinct())
    # One text of each set.
    which = meta.join(every, "set").groupBy("set", "label", "size").agg(F.min(F.struct("h", "c")).alias("t")).select("set", "label", "size", "t.h", "t.c").join(held.select("set", "docs"), "set")
    which = cut(which)
    blocks = F.ceil(F.greatest(F.sum("size") / GRAMS, F.count("*") / MEMBERS)).cast("int")
    blocks = cut(which.groupBy("label").agg(blocks.alias("blocks"), F.sum("size").alias("grams")))
    total = blocks.agg(F.sum(F.col("grams") * F.col("blocks"))).first()[0] or 0
    placed = cut(which.join(if_small(blocks.select("label", "blocks")), "label").withColumn("block", F.pmod(F.xxhash64("set"), "blocks").cast("int")).drop("size"))
    drop(which)
    drop(blocks)
    rows = texts.join(if_small(placed), ["h", "c"]).dropDuplicates(["set"])
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "set", "docs", "text")
    bucket = F.pmod(F.xxhash64("label", "lo", "hi"), F.lit(-(-total // (2 * GRAMS)) or 1))
    found = rows.groupBy(bucket.alias("bucket")).applyInArrow(count, "set long, more long")
    out = cut(found.groupBy("set").agg(F.sum("more").alias("more")))
    drop(placed)
    return out


def _together(pairs: DataFrame, sets: DataFrame, each: int, check, shape: str) -> DataFrame:
    """Applies ``check`` to buckets of about ``each`` pairs and the rows of ``sets`` of their members. pairs: a cut with least, piece, a, b."""
    buckets = max(1, -(-pairs.count() // each))
    keyed = pairs.withColumn("bucket", F.pmod(F.xxhash64("least", "piece"), F.lit(buckets)))
    members = keyed.select("bucket", F.explode(F.array("a", "b")).alias("set")).distinct()
    held = members.join(sets, "set").withColumnRenamed("bucket", "at")
    return keyed.groupBy("bucket").cogroup(held.groupBy("at")).applyInPandas(check, shape)


def _star_pieces(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (least, piece, a, b) of each a with its b, STAR in a piece. A cut."""
    once = cut(pairs.select("a", "b").distinct())
    large = cut(once.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > STAR).select("a", F.ceil(F.col("n") / STAR).alias("blocks")))
    placed = once.join(if_small(large), "a", "left")
    out = cut(placed.select(F.col("a").alias("least"), F.coalesce(F.pmod(F.xxhash64("b"), "blocks"), F.lit(0)).cast("long").alias("piece"), "a", "b"))
    drop(once)
    drop(large)
    return out


def _pieces(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (least, piece, a, b) under the least of their names, so that similar sets mostly are in one piece; large pieces are cut by blocks of sets. A cut."""
    once = cut(pairs.groupBy("a", "b").agg(F.min("least").alias("least")))
    # At most one row for PIECE pairs.
    large = cut(once.groupBy("least").agg(F.count("*").alias("n")).filter(F.col("n") > PIECE).withColumn("blocks", F.ceil(F.sqrt(F.col("n") / PIECE))))
    placed = once.join(if_small(large.select("least", "blocks")), "least", "left")
    block = F.pmod(F.xxhash64("a"), "blocks") * F.col("blocks") + F.pmod(F.xxhash64("b"), "blocks")
    out = cut(placed.select("least", F.coalesce(block, F.lit(0)).cast("long").alias("piece"), "a", "b"))
    drop(once)
    drop(large)
    return out


def _verified(texts: DataFrame, meta: DataFrame, pairs: DataFrame, n: int, theta: float, pieces: Callable[[DataFrame], DataFrame] = _pieces) -> DataFrame:
    """(a, b, jaccard) of the candidate pairs that reach theta. Bitmaps rule most out; the others are verified from whole texts. texts: h, c, text."""

    def screen(key, pdf, sets):
        at = dict(zip(sets["set"].tolist(), range(len(sets))))
        size, bits = sets["size"].to_numpy().astype(np.float64), sets["bits"].tolist()
        a, b = [at[x] for x in pdf["a"].tolist()], [at[x] for x in pdf["b"].tolist()]
        keep = possible(size[a], size[b], [bits[i] for i in a], [bits[i] for i in b], theta) if len(pdf) else np.zeros(0, dtype=bool)
        return pdf.loc[keep, ["least", "piece", "a", "b"]]

    def verify(key, pdf, sets):
        import pandas as pd

        grams = dict(zip(sets["set"].tolist(), (g for _, g in gram_sets(sets["text"].tolist(), n))))
        a, b = pdf["a"].tolist(), pdf["b"].tolist()
        sim = np.zeros(len(a))
        for i, (x, y) in enumerate(zip(a, b)):
            gx, gy = grams[x], grams[y]
            if len(gx) > len(gy):
                gx, gy = gy, gx
            at = np.minimum(np.searchsorted(gy, gx), len(gy) - 1)
            both = int((gy[at] == gx).sum())
            sim[i] = both / (len(gx) + len(gy) - both)
        keep = sim >= theta
        grams.clear()
        tokens.release()
        return pd.DataFrame({"a": np.array(a, dtype=np.int64)[keep], "b": np.array(b, dtype=np.int64)[keep], "jaccard": sim[keep]})

    sketches = meta.select("set", "size", "bits").dropDuplicates(["set"])
    left = pieces(_together(pairs, sketches, 20_000, screen, "least long, piece long, a long, b long"))
    wanted = left.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    # One text of each set.
    which = cut(meta.join(wanted, "set", "left_semi").groupBy("set").agg(F.min(F.struct("h", "c")).alias("t")).select("set", "t.h", "t.c"))
    held = texts.join(if_small(which), ["h", "c"]).dropDuplicates(["set"])
    found = cut(_together(left, held.select("set", "text"), 1_000, verify, "a long, b long, jaccard double"))
    drop(left)
    drop(which)
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, c, text) of texts that aren't null; h and c are 96 bits that stand for a text."""
    return docs.filter("text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.crc32("text").alias("c"), "text")


def _prepared(docs: DataFrame, n: int, theta: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, texts, several, meta, index): (doc_id, h, c, set) of each row that has words; (h, c, text) of each text once, read over ``several``; (h, c, set, size, bits) of each text; and its signatures. All but texts are cuts."""
    if not LEAST <= theta <= 1:
        raise ValueError(f"theta must be from {LEAST} to 1")
    keyed = _keyed(docs)
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    # Texts of several rows, and which row stands for all.
    several = cut(keyed.groupBy("h", "c").agg(F.min(order).alias("lo"), F.count("*").alias("rows")).filter("rows > 1").select("h", "c", "lo"))
    texts = keyed.join(if_small(several), ["h", "c"], "left").filter(F.col("lo").isNull() | (order == F.col("lo"))).select("h", "c", "text")
    grams = max(1, (keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)
    bits = min(KEY[1], max(KEY[0], grams.bit_length() + SPARE))
    ranges = -(-grams // RANGE)
    scan = cut(_scan(texts, n, bits, ranges))
    index = cut(_index(scan, theta, bits, ranges))
    every = scan.filter("part = -2").select("h", "c", "set", "check", "size", "bits")
    canon = every.groupBy("set").agg(F.min("check").alias("check"))
    meta = cut(every.join(canon, ["set", "check"]).dropDuplicates(["h", "c"]).select("h", "c", "set", "size", "bits"))
    drop(scan)
    rows = cut(keyed.select("doc_id", "h", "c").join(meta.select("h", "c", "set"), ["h", "c"]))
    return rows, texts, several, meta, index


def similar_sets(docs: DataFrame, n: int = N, theta: float = THETA) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, c, set) of each row of ``docs`` that has words, and (a, b, jaccard), a < b, of pairs of different sets. Cuts.

    h and c tell the text. Of texts whose sets differ in spite of equal 64 bits, only those of one set are there.
    """
    rows, texts, several, meta, index = _prepared(docs, n, theta)
    lists = index.repartition("sig").sortWithinPartitions("sig").mapInArrow(tokens.tidy(_lists), "least long, split int, sets array<long>, sizes array<int>")
    pairs = cut(_candidates(lists, theta))
    drop(index)
    near = _verified(texts, meta, pairs, n, theta)
    for x in (pairs, meta, several):
        drop(x)
    return rows, near


def linked_sets(docs: DataFrame, n: int = N, theta: float = THETA, counted: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """As ``similar_sets``, but (node, head), the least set that each set reaches over links, in place of pairs. Cuts.

    ``counted``: the third table is (set, more), the number of doc_ids of the sets that each set is linked to.
    """
    shape = "least long, split int, sets array<long>, sizes array<int>"
    rows, texts, several, meta, index = _prepared(docs, n, theta)
    lists = index.repartition("sig").sortWithinPartitions("sig").mapInArrow(tokens.tidy(_whole_lists), shape)
    lists = cut(lists.repartition("least").sortWithinPartitions("least").mapInArrow(tokens.tidy(_different), shape))
    drop(index)
    star = lists.select("least", F.col("sizes")[0].alias("own"), F.inline(F.arrays_zip("sets", "sizes"))).filter("sets <> least")
    star = star.filter(F.least("own", "sizes") >= theta * F.greatest("own", "sizes"))
    star = cut(star.select("least", F.lit(0).cast("long").alias("piece"), F.col("least").alias("a"), F.col("sets").alias("b")).distinct())
    near = _verified(texts, meta, star, n, theta, _star_pieces)
    labels = cut(groups(near.select("a", "b")))
    drop(star)
    drop(near)
    pairs = cut(_across(lists, labels, theta))
    drop(lists)
    other = _verified(texts, meta, pairs, n, theta)
    drop(pairs)
    heads, more = labels, None
    if other.limit(1).count():
        heads = cut(groups(labels.toDF("a", "b").unionByName(other.select("a", "b"))))
    if counted:
        held = cut(rows.select("doc_id", "set").distinct().groupBy("set").agg(F.count("*").alias("docs")))
        both = other.select("a", "b").unionByName(other.select(F.col("b").alias("a"), F.col("a").alias("b")))
        across = both.join(held.select(F.col("set").alias("b"), "docs"), "b").select(F.col("a").alias("set"), F.col("docs").alias("more"))
        inside = _inside(texts, meta, held, labels, n, theta)
        more = cut(inside.unionByName(across).groupBy("set").agg(F.sum("more").alias("more")))
        drop(inside)
        drop(held)
    for x in (other, meta, several):
        drop(x)
    return rows, heads, more


def jaccard_join(docs: DataFrame, n: int = N, theta: float = THETA) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: all pairs of documents of similarity ``theta`` or more.

    Words are cut at white space, case counts; a text of fewer than ``n`` words
    is a single n-gram. Null texts, texts without words and null doc_ids have no
    pairs. Rows that share a doc_id aren't paired with each other, and a pair of
    doc_ids comes once, with its highest similarity. Equal texts pair at 1, and
    are spelled out in pairs: where there are many copies, ``similar_groups`` is
    the same in a row a document. Texts are read whole, whatever their length;
    other columns are ignored, and an empty table has no pairs.
    """
    rows, near = similar_sets(docs, n, theta)
    ids = rows.filter("doc_id is not null").select("doc_id", "set").distinct()
    a, b = ids.toDF("doc_a", "a"), ids.toDF("doc_b", "b")
    same = a.join(b, F.col("a") == F.col("b")).filter("doc_a < doc_b").select("doc_a", "doc_b", F.lit(1.0).alias("jaccard"))
    other = near.join(a, "a").join(b, "b").filter("doc_a <> doc_b")
    other = other.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")
    return same.unionByName(other).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def groups(edges: DataFrame) -> DataFrame:
    """(node, head): the least node of each node's connected component, by alternating star contraction.

    Each round is a few joins on a table that only shrinks; a component of
    diameter d takes about log(d) rounds.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = state(edges)
    while True:
        # Large star: each node's larger neighbours go to its least one. Small star: its smaller ones do.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(small.distinct())
        drop(edges)
        drop(large)
        edges, now = after, state(after)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("head"))
        before = now


def similar_groups(docs: DataFrame, n: int = N, theta: float = THETA) -> DataFrame:
    """(doc_id, class_id, links) of every document.

    links is the number of other documents of similarity ``theta`` or more,
    equal texts too, and class_id the least doc_id that is reached over such
    links. Pairs are never spelled out between equal sets, so a text of many
    copies costs no more than its rows; pairs of different sets are all there.

    Words are cut at white space, case counts; a text of fewer than ``n`` words
    is a single n-gram. Documents of a null text or without words have no links
    and are their own class. Rows of a null doc_id are left out and link
    nothing. Equal rows are one; different texts of one doc_id each have a row,
    and count once for a text similar to them. Texts are read whole, whatever
    their length; other columns are ignored; an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    rows, heads, more = linked_sets(docs, n, theta, counted=True)
    ids = cut(rows.select("doc_id", "set").distinct())
    held = cut(ids.groupBy("set").agg(F.count("*").alias("docs"), F.min("doc_id").alias("least")))
    placed = held.join(heads.select(F.col("node").alias("set"), "head"), "set", "left").withColumn("head", F.coalesce("head", "set"))
    least = placed.groupBy("head").agg(F.min("least").alias("class_id"))
    each = placed.join(least, "head").join(more, "set", "left")
    each = each.select("set", "class_id", (F.col("docs") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    found = ids.join(each, "set").select("doc_id", "class_id", "links")
    bare = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select("doc_id").distinct()
    return found.unionByName(bare.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def near_dedup(docs: DataFrame, n: int = N, theta: float = THETA) -> DataFrame:
    """``docs`` with one document of each group of near copies: that of the least doc_id.

    A group is a connected component of pairs of similarity ``theta`` or more.
    Pairs are never spelled out between equal sets, so a text of many copies
    costs no more than its rows. Null texts and texts without words stay, and
    null doc_ids come last in a group. Of rows that share the group's least
    doc_id one stays, of the least text by its hash. All columns stay as they
    are, whatever their names; texts are read whole; an empty table stays empty.
    """
    rows, heads, _ = linked_sets(docs, n, theta)
    grouped = rows.join(heads.select(F.col("node").alias("set"), "head"), "set", "left").select("doc_id", "h", "c", F.coalesce("head", "set").alias("head"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "c")
    best = grouped.groupBy("head").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    # Groups of one need no decision; the documents that go are few beside those that stay.
    loser = (
        grouped.join(best.filter("n > 1"), "head")
        .groupBy("doc_id", "h", "c", "first")
        .agg(F.count("*").alias("rows"))
        .withColumn("stay", F.expr("int(first.doc_id <=> doc_id and first.h = h and first.c = c)"))
        .select(F.col("doc_id").alias("__lamina_id"), F.col("h").alias("__lamina_h"), F.col("c").alias("__lamina_c"), "stay", "rows")
        .filter("stay = 0 or rows > 1")
    )
    loser = cut(loser)
    keyed = docs.withColumns({"__lamina_x": F.xxhash64("text"), "__lamina_y": F.crc32("text")})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__lamina_id")) & (F.col("__lamina_x") == F.col("__lamina_h")) & (F.col("__lamina_y") == F.col("__lamina_c"))
    gone = keyed.join(if_small(cut(loser.filter("stay = 0"))), same, "left_anti")
    twins = cut(loser.filter("stay = 1").select("__lamina_id", "__lamina_h", "__lamina_c", "stay"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not twins.limit(1).count():
        return gone.select(*columns)
    joined = gone.join(if_small(twins), same, "left")
    kept = joined.filter("stay = 1").dropDuplicates(["doc_id", "__lamina_x", "__lamina_y"])
    return joined.filter("stay is null").select(*columns).unionByName(kept.select(*columns))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of similar ones, by the least doc_id, and its number of links of similarity THETA or more."""
    return similar_groups(documents(spark, sf_dir).select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END) AS gram
  FROM w WHERE len(w) > 0
), s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), p AS (
  SELECT doc_a, doc_b FROM o JOIN s x ON x.doc_id = doc_a JOIN s y ON y.doc_id = doc_b
  WHERE shared::DOUBLE / (x.n + y.n - shared) >= {THETA}
), r AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, p.doc_b FROM r JOIN p ON p.doc_a = r.other
)
SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM p WHERE doc_a = doc_id) AS links FROM r GROUP BY doc_id
"""
