"""Mixing: the rounding keeps its promises, in a table too, whose every row is held against plain counts."""

import math
from collections import Counter

import numpy as np
import pytest
from conftest import DATA

from lamina.llm import mixing
from lamina.llm.mixing import copies, mix, op4_mixing, pivotal

SHAPE = "doc_id long, source string"


def test_pivotal_keeps_the_sum_and_leaves_one_fraction_at_most():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 9, 400):
        p = rng.random(n)
        out = pivotal(p, rng)
        assert math.isclose(out.sum(), p.sum(), abs_tol=1e-6)
        assert sum(0 < x < 1 for x in out) <= 1


def test_pivotal_is_unbiased():
    p = np.array([0.1, 0.5, 0.9, 0.3, 0.2])
    mean = np.mean([pivotal(p, np.random.default_rng(i)) for i in range(6000)], axis=0)
    assert np.abs(mean - p).max() < 0.02


def targets(sizes, total):
    w = {s: n**mixing.DAMPING for s, n in sizes.items()}
    return {s: total * x / sum(w.values()) for s, x in w.items()}


@pytest.mark.parametrize("leaf", [7, 20_000])
def test_each_source_gets_its_target(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(i, "big" if i < 300 else "mid" if i < 390 else None if i < 400 else "tiny") for i in range(410)]
    got = copies(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted(r.doc_id for r in got) == list(range(410))
    by, want = Counter(), targets({"big": 300, "mid": 90, "": 10, "tiny": 10}, 410)
    n = {"big": 300, "mid": 90, "": 10, "tiny": 10}
    for r in got:
        by[r.site] += r.copies
        e = want[r.site] / n[r.site]
        assert math.floor(e) <= r.copies <= math.floor(e) + 1
    assert all(abs(by[s] - want[s]) < 1 for s in want)
    assert sum(by.values()) == 410
    again = copies(spark.createDataFrame(rows, SHAPE).repartition(5)).collect()
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again}


def test_mix_repeats_rows(spark):
    rows = [(i, f"t{i}", "ab"[i % 2], i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = mix(df, {"a": 3, "b": 1, "c": 9}, total=80)
    assert out.columns == df.columns
    by = Counter(r.source for r in out.collect())
    assert by == {"a": 60, "b": 20}
    assert mix(df, {"a": 1}).filter("source = 'b'").count() == 0
    assert mix(df, {}).count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (1, None), (1, None), (2, ""), (3, "y")], SHAPE)
    assert mix(df, {"x": 1, "": 1, "y": 1}, total=9).count() == 9
    assert mix(df).count() == 6
    assert mix(spark.createDataFrame([], SHAPE)).count() == 0


def test_the_mixture_of_a_whole_table(spark):
    """Rows are those of documents, by whole rows, each as often as its source's target allows, and sources meet their targets."""
    sf = f"{DATA}/sf0.001"
    rows = Counter(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").collect()))
    got = Counter(map(tuple, op4_mixing(spark, sf).collect()))
    assert set(got) <= set(rows) and sum(got.values()) == sum(rows.values())
    sizes, by = Counter(), Counter()
    for r, n in rows.items():
        sizes[r[3]] += n
    want = targets(sizes, sum(sizes.values()))
    for r, n in rows.items():
        e = n * want[r[3]] / sizes[r[3]]
        assert math.floor(e) <= got[r] <= math.floor(e) + 1
        by[r[3]] += got[r]
    assert all(abs(by[s] - want[s]) < 1 for s in want)


def test_large_and_null_ids_null_columns_maps_and_clashing_names(spark):
    shape = "doc_id long, source string, text string, note string, tags map<string,int>, nested struct<a:string,b:array<string>>, copies int, site string, `key` string"
    rows = [((1 << 60) + i, "s", f"t{i}", None, None, None, i, "x", "k") for i in range(6)]
    rows += [(None, "s", "n1", None, None, None, 0, "x", "k"), (None, "s", "n2", None, None, None, 0, "x", "k")]
    rows += [(1, "s", "a", None, None, None, 0, "x", "k"), (1, "s", None, "a", None, None, 0, "x", "k")]
    rows += [(2, "s", "m", None, {"k": 1}, None, 0, "x", "k"), (2, "s", "m", None, {"k": 2}, None, 0, "x", "k")]
    rows += [(3, "s", "m", None, None, ("a", ["b", None]), 0, "x", "k"), (3, "s", "m", None, None, ("a", [None, "b"]), 0, "x", "k"), (3, "s", "m", None, None, (None, ["b"]), 0, "x", "k")]
    rows += [(4 + i, "s", "w " * 100_000 if not i else "", None, None, None, 0, "x", "k") for i in range(5)]
    df = spark.createDataFrame(rows, shape)
    assert sorted(map(repr, mix(df).collect())) == sorted(map(repr, df.collect()))
    found = copies(df).collect()
    assert len(found) == len(rows) and all(r.copies == 1 for r in found) and sum(r.doc_id is None for r in found) == 2
    twice = Counter(map(repr, mix(df, {"s": 1}, total=2 * len(rows)).collect()))
    assert set(twice.values()) == {2} and len(twice) == len(rows)
