"""Approximate neighbours against brute force."""

import numpy as np
import pytest
from conftest import DATA

from lamina.llm import hilbert_ann
from lamina.llm.hilbert_ann import choose, hilbert, nearest

SHAPE = "vec_id long, embedding array<float>"


def exact(ids, x, k):
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sim = np.round(x @ x.T, 6) + 0.0
    np.fill_diagonal(sim, -2)
    return {i: [int(ids[j]) for j in np.lexsort((ids, -s))[:k]] for i, s in zip(ids.tolist(), sim)}


def found(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.vec_id, [])) + 1
        out[r.vec_id].append(r.neighbour)
    return out


def test_curve_visits_every_cell_once_by_single_steps():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3), axis=-1).reshape(-1, 3)
    key = hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_recall_of_small_blocks(spark):
    table = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    want, got = exact(ids, x, 10), found(nearest(table, block=256))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    recall = np.mean([len(set(want[i]) & set(got[i])) / 10 for i in want])
    assert recall >= 0.9, recall


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (5, None), (6, []), (7, [float("nan"), 1.0]),
        (8, [1.0, 2.0, 3.0]), (9, [None, 1.0]), (1, [1.0, 0.0]), (10, [-1.0, 0.0]),
    ]
    good = [(1, [1, 0]), (2, [1, 0]), (3, [0, 2]), (4, [0, 0]), (10, [-1, 0])]
    got = found(nearest(spark.createDataFrame(rows, SHAPE), k=3))
    assert got == exact(np.array([i for i, _ in good]), np.array([v for _, v in good], dtype=float), 3)
    assert nearest(spark.createDataFrame([], SHAPE)).count() == 0
    assert nearest(spark.createDataFrame([(1, [1.0])], SHAPE)).count() == 0
    extra = spark.createDataFrame([(1, [1.0, 0.0], 5, "x"), (2, [0.0, 1.0], 6, "y")], SHAPE + ", rank int, id string")
    assert nearest(extra).columns == ["vec_id", "rank", "neighbour", "similarity"]


@pytest.mark.parametrize("k", [1, 4])
def test_ties_go_to_the_smaller_id(spark, k):
    rows = [(i, [1.0, 1.0]) for i in range(8)]
    assert found(nearest(spark.createDataFrame(rows, SHAPE), k=k)) == {i: [j for j in range(8) if j != i][:k] for i in range(8)}


@pytest.mark.parametrize("pairs", [True, False])
def test_recall_of_tiny_blocks(spark, monkeypatch, pairs):
    """Blocks of 0.4 % of the table, in vectors without structure: the reach must grow with the table. Once with all pairs ruled out."""
    monkeypatch.setattr(hilbert_ann, "COPY", 0)
    if not pairs:
        monkeypatch.setattr(hilbert_ann, "choose", lambda gaps, n, block, share: choose(gaps, 10 * n, block, share)[:3] + (0,))
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6_000, 64)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SHAPE)
    got = found(nearest(table, block=24, asks="vec_id % 20 = 0"))
    ids, some = np.arange(len(x)), np.arange(0, len(x), 20)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sim = np.round(unit[some] @ unit.T, 6)
    sim[np.arange(len(some)), some] = -2
    want = [set(np.lexsort((ids, -s))[:10].tolist()) for s in sim]
    recall = np.mean([len(w & set(got[i])) / 10 for i, w in zip(some.tolist(), want)])
    assert len(got) == len(some) and recall >= 0.9, recall


def test_curves_follow_structure(spark, monkeypatch):
    """Vectors on a surface of two dimensions, in 94 blocks: a quarter of all comparisons at most, and the recall."""
    taken = []
    monkeypatch.setattr(hilbert_ann, "COPY", 0)
    monkeypatch.setattr(hilbert_ann, "choose", lambda *args: taken.append(choose(*args)) or taken[0])
    rng = np.random.default_rng(6)
    at = rng.random((12_000, 2)) * 2
    x = np.concatenate([np.sin(at @ rng.standard_normal((2, 32))), np.cos(at @ rng.standard_normal((2, 32)))], axis=1).astype(np.float32)
    x[-50:] = x[0]  # equal vectors
    got = found(nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SHAPE), block=128, asks="vec_id % 20 = 0"))
    curves, block, reach, _ = taken[0]
    assert curves * (2 * reach + 1) * block <= len(x) / 4
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    recall = []
    for i in range(20, len(x), 20):
        sim = np.round(unit @ unit[i], 6)
        sim[i] = -2
        least = np.sort(sim)[-10]
        recall.append(np.mean([sim[j] >= least for j in got[i]]))
    assert len(got) == 600 and np.mean(recall) >= 0.9, np.mean(recall)


def test_settings_keep_the_recall_at_every_size():
    rng = np.random.default_rng(1)
    for n in (10_000, 1_000_000, 100_000_000):
        gaps = np.abs(rng.random((500, 24)) - rng.random((500, 24))) * n / 4
        curves, block, reach, kept = choose(gaps, n, 4096)
        covered = np.clip(reach + 1 - gaps[:, :curves] / block, 0, 1)
        assert kept >= hilbert_ann.RECALL and block <= hilbert_ann.LARGEST
        assert kept == 1.0 and block * (reach + 1) >= n or 1 - np.prod(1 - covered, axis=1).mean() == pytest.approx(kept)
