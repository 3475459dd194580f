"""The n-gram join against all pairs, and its groups against union-find."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import ngram_join
from lamina.llm.ngram_join import groups, jaccard_join, near_dedup, possible, similar_groups

SHAPE = "doc_id long, text string"


def gram_set(text, n=3):
    w = text.split() if text else []
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, theta):
    best = {}
    sets = [(i, gram_set(t)) for i, t in rows if i is not None]
    for (i, a), (j, b) in combinations(sets, 2):
        if i != j and a and b and (s := len(a & b) / len(a | b)) >= theta:
            key = min(i, j), max(i, j)
            best[key] = max(best.get(key, 0), s)
    return best


def copies(rng, n, words=40):
    """Texts of a small vocabulary, so that n-grams repeat, and copies of them with some words changed."""
    vocabulary = [f"v{i}" for i in range(12)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, words))] for _ in range(n)]
    for _ in range(2 * n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        base.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(base)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "RANGE", 500)  # several ranges
    rows = copies(random.Random(seed), 60)
    found = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_join(spark.createDataFrame(rows, SHAPE)).collect()}
    want = brute(rows, ngram_join.THETA)
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-12 for k in want)


def met(sets, lots, bits, ranges, theta):
    """Pairs that share a signature, by what the jobs run, in one process."""
    blobs, heads = {}, {}
    for lot in range(lots):
        own = [(i, g) for i, g in enumerate(sets) if i % lots == lot]
        for part, blob in ngram_join._lot([g for _, g in own], [i for i, _ in own], bits, ranges):
            (heads if part < 0 else blobs.setdefault(part, {}))[lot] = blob
    back = {lot: [(-1, blob)] for lot, blob in heads.items()}
    for part, held in blobs.items():
        out = ngram_join._counted(pa.table({"part": pa.array([part] * len(held), pa.int32()), "lot": list(held), "blob": list(held.values())}), bits, ranges)
        for lot, blob in zip(out["lot"].to_pylist(), out["blob"].to_pylist()):
            back[lot].append((part, blob))
    signed = pa.concat_tables(
        ngram_join._signed(pa.table({"part": pa.array([p for p, _ in x], pa.int32()), "lot": [lot] * len(x), "blob": [b for _, b in x]}), theta, bits, ranges)
        for lot, x in back.items()
    )
    lists = list(ngram_join._lists(signed.sort_by("sig").to_batches(max_chunksize=7)))
    table = pa.Table.from_batches(lists).sort_by("least") if lists else None
    found = set()
    for _, group in ngram_join._whole_groups(table.to_batches(max_chunksize=5) if table else []):
        for a, b in ngram_join._pairs_of(group, theta):
            found |= set(zip(a.tolist(), b.tolist()))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_no_pair_is_lost_whatever_is_frequent_or_hot(monkeypatch, seed):
    """Small classes, lots, blocks and keys make combinations, hot n-grams, split lists and chance agreement common."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(ngram_join, "CLASSES", [[(2, 2), (8, 3)], [(4, 2), (4096, 3)], [(64, 2), (4096, 3)]][seed % 3])
    monkeypatch.setattr(ngram_join, "LOCAL", [1, 3, 16][seed % 3])
    monkeypatch.setattr(ngram_join, "BLOCK", [3, 5, 512][seed % 3])
    theta = [0.5, 0.4][seed % 2]
    pool = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    sets = []
    for _ in range(60):
        base = rng.choice(pool[: rng.choice([60, 4000])], int(rng.integers(1, 60)), replace=False)
        for _ in range(int(rng.integers(1, 5))):
            own = base.copy()
            change = rng.random(len(own)) < rng.choice([0, 0.1, 0.25])
            own[change] = rng.integers(0, 1 << 63, int(change.sum())).astype(np.uint64)
            sets.append(np.unique(own))
    want = set()
    for (i, a), (j, b) in combinations(enumerate(sets), 2):
        both = len(np.intersect1d(a, b))
        if both / (len(a) + len(b) - both) >= theta:
            want.add((i, j))
    assert len(want) > 50
    assert want <= met(sets, 4, [36, 14, 48][seed % 3], [3, 1, 7][seed % 3], theta)


def test_blobs_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        given = [rng.integers(0, 1 << 37, n).astype(np.uint64), rng.integers(0, 60_000, n).astype(np.uint16), np.zeros(n, np.uint8)]
        found = ngram_join._unpack(ngram_join._pack(*given))
        assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(given, found))


def classes(rows, theta):
    """(doc_id, class_id, links) of rows of different doc_ids."""
    pairs = brute(rows, theta)
    heads = union(pairs)
    links = Counter(x for p in pairs for x in p)
    return sorted((i, heads.get(i, i), links[i]) for i, _ in rows)


def test_a_row_for_each_document(spark):
    rows = copies(random.Random(4), 40) + [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "one"), (905, "a " * 100_000)]
    df = spark.createDataFrame([(i, t, i, "x", 0) for i, t in rows], "doc_id long, text string, class_id long, set string, h int")
    assert sorted(tuple(r) for r in similar_groups(df).collect()) == classes(rows, ngram_join.THETA)
    assert similar_groups(spark.createDataFrame([], SHAPE)).count() == 0


def test_rows_of_repeated_and_null_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, "a b c d"), (6, "x y z"), (7, "x y z"), (8, None)]
    found = sorted(tuple(r) for r in similar_groups(spark.createDataFrame(rows, SHAPE)).collect())
    assert found == [(5, 5, 1), (6, 5, 1), (6, 6, 1), (7, 6, 1), (8, 8, 0)]


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [
        (1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e f"), (3, None), (4, ""), (5, " \n\t"), (None, "a b c d e"), (6, "a"), (7, "a"), (8, "a b"),
        (9, long), (10, long + " more"), (1, "a b c d e"),
    ]
    found = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_join(spark.createDataFrame(rows, SHAPE)).collect()}
    assert found == pytest.approx(brute(rows, ngram_join.THETA))
    assert jaccard_join(spark.createDataFrame([], SHAPE)).count() == 0


def test_bitmaps_never_rule_out_a_pair():
    rng = np.random.default_rng(1)

    def bits(g):
        width = max(64, 1 << (len(g) - 1).bit_length())
        return np.packbits((np.bincount((g % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()

    for _ in range(300):
        n, shared = int(rng.integers(1, 400)), rng.random()
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[: int(n * shared)], rng.integers(0, 1 << 63, int(rng.integers(1, n + 1))).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        similar = both / (len(a) + len(b) - both) >= 0.65
        keep = possible(np.array([len(a)]), np.array([len(b)]), [bits(a)], [bits(b)], 0.65)[0]
        assert keep or not similar


def union(edges):
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(head)}


def test_groups_are_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    found = {r.node: r.head for r in groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in union([e for e in edges if e[0] != e[1]]).items() if k != v}
    assert {k: v for k, v in found.items() if k != v} == want
    assert groups(spark.createDataFrame([], "a long, b long")).count() == 0


def survivors(rows, theta):
    """doc_ids that stay: the least of each component; documents without words all stay."""
    ids = {i: gram_set(t) for i, t in rows}
    heads = union(brute(rows, theta))
    return {i for i in ids if not ids[i] or heads.get(i, i) == i}


def test_one_of_each_group_stays(spark):
    rows = copies(random.Random(9), 40) + [(900, None), (901, ""), (902, "  ")]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, source string, text_hash long")
    out = near_dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(survivors(rows, ngram_join.THETA))


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, "a b c d"), (None, "x y z"), (None, "x y z"), (7, None), (7, None)]
    out = [tuple(r) for r in near_dedup(spark.createDataFrame(rows, SHAPE)).collect()]
    assert sorted(out, key=repr) == sorted([(5, "a b c d"), (None, "x y z"), (7, None), (7, None)], key=repr)
    assert near_dedup(spark.createDataFrame([], SHAPE)).count() == 0


@pytest.mark.parametrize("theta", [0.4, 0.5])
def test_sets_of_far_sizes_meet(theta):
    """Of pairs at the bound, of one part in the other and of equal sizes, each shares a signature, whatever is frequent."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        size = int(rng.integers(1, 600))
        b = np.unique(rng.integers(0, 1 << 40, size).astype(np.uint64))
        a = np.sort(rng.choice(b, int(np.ceil(theta * len(b))), replace=False))
        both = int(np.ceil(2 * theta / (1 + theta) * size))
        c = np.unique(np.concatenate([b[:both], rng.integers(0, 1 << 40, max(0, len(b) - both)).astype(np.uint64)]))
        known = np.unique(np.concatenate([b, c]))
        # Shared ones are in two texts at least, the others anywhere; more often than not many are frequent.
        level = np.where(rng.random(len(known)) < rng.choice([0.0, 0.5, 0.9, 1.0]), rng.integers(6, 14, len(known)), rng.integers(0, 6, len(known)))
        for x in (a, c):
            shared = np.intersect1d(x, b)
            if len(shared) / (len(x) + len(b) - len(shared)) >= theta:
                own = np.where(np.isin(known, shared), np.maximum(level, 1), level)
                sigs = []
                for g in (x, b):
                    at = np.searchsorted(known, g)
                    there = own[at] > 0
                    key, lev = g[there], own[at][there]
                    by = np.lexsort((key, lev))
                    sigs.append(ngram_join.signatures(key[by], lev[by], len(g), theta))
                assert len(np.intersect1d(*sigs)), (len(x), len(b))


def test_edited_copies_are_near(spark):
    """Every ninth word is another: two thirds of the words' trigrams stay, of Jaccard similarity 0.5."""
    words = [f"w{i}" for i in range(2001)]
    edited = [f"x{i}" if i % 9 == 4 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "else " * 50)], SHAPE)
    assert [(r.doc_a, r.doc_b) for r in jaccard_join(docs).collect()] == [(1, 2)]
    assert sorted(r.doc_id for r in near_dedup(docs).collect()) == [1, 3]


def test_a_cluster_costs_as_many_candidates_as_sets(spark, monkeypatch):
    """Near copies of one text, some of them far from others: links and classes as by brute force, without the square of candidates; in blocks."""
    rng = random.Random(11)
    base, rows, seen = [f"w{i}" for i in range(120)], copies(rng, 15), []
    for i in range(150):
        change = rng.choice([1, 2, 4, 10, 14])
        rows.append((1000 + i, " ".join(f"x{i}_{k}" if rng.random() < change / 120 else w for k, w in enumerate(base))))
    verified = ngram_join._verified

    def counted(texts, meta, pairs, *more):
        seen.append(pairs.count())
        return verified(texts, meta, pairs, *more)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    monkeypatch.setattr(ngram_join, "MEMBERS", 40)
    found = similar_groups(spark.createDataFrame(rows, SHAPE)).collect()
    want = classes(rows, ngram_join.THETA)
    assert sorted(tuple(r) for r in found) == want
    links = sum(n for _, _, n in want) // 2
    assert links > 5000 and sum(seen) < links / 2


@pytest.mark.parametrize("sparse", [1, 64, 10_000])
def test_products_count_what_sets_share(monkeypatch, sparse):
    monkeypatch.setattr(ngram_join, "SPARSE", sparse)
    rng = np.random.default_rng(sparse)
    pool = np.arange(1, 900, dtype=np.uint64)
    a, b = ([np.unique(rng.choice(pool[: int(rng.integers(1, 900))], int(rng.integers(1, 80)))) for _ in range(k)] for k in (30, 21))
    assert (ngram_join.shared(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
    both = np.array([[len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for y in a] for x in a])
    assert (ngram_join.linked(a, None, 0.5) == (both >= 0.5) & ~np.eye(len(a), dtype=bool)).all()
