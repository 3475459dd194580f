"""Substring dedup against a brute-force version over all windows of all documents."""

import random

import pytest
from conftest import DATA

from lamina.llm.substring_dedup import Automaton, spans, substring_dedup

SHAPE = "doc_id long, text string"


def brute(rows, span):
    """Words left of each row: windows of an earlier doc_id go."""
    top = 1 << 63
    docs = [(top if i is None else i, None if t is None else t.split()) for i, t in rows]
    first = {}
    for i, w in sorted((d for d in docs if d[1]), key=lambda d: d[0]):
        for k in range(len(w) - span + 1):
            first.setdefault(tuple(w[k : k + span]), i)
    out = []
    for i, w in docs:
        if w is None:
            out.append(None)
            continue
        gone = set()
        for k in range(len(w) - span + 1):
            if first[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def check(spark, rows, span, size):
    found = substring_dedup(spark.createDataFrame(rows, SHAPE), span, size).collect()
    want = brute(rows, span)
    ours = sorted(((r.doc_id, r.text if r.text is None else tuple(r.text.split())) for r in found), key=repr)
    theirs = sorted(((i, w if w is None else tuple(w)) for (i, _), w in zip(rows, want)), key=repr)
    assert ours == theirs
    gone = sum(len(t.split()) for _, t in rows if t) - sum(len(w) for w in want if w)
    assert sum(r.removed_words for r in found) == gone


def test_random_texts_with_shared_passages(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdef", k=2))
    pool = [[word() for _ in range(rng.randint(4, 25))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(1, 5)):
            w += rng.choice(pool) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 12))]
        rows.append((rng.randint(0, 90), " ".join(w)))
    rows += [(200 + i, rows[i][1]) for i in range(20)]  # exact copies
    check(spark, rows, 6, 3)


def test_nulls_empties_ties_repeats_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, "  \n "), (4, "a b c d e f g h"), (4, "a b c d e f g h"), (4, "x a b c d e f"), (5, "q\ta b  c d e f g h z"),
        (None, "a b c d e f g h"), (None, "n1 n2 n3 n4 n5 n6 n7"), (None, "n1 n2 n3 n4 n5 n6 n7 n8"), (7, "a b c d e f a b c d e f"), (8, long), (9, "start " + long),
    ]
    check(spark, rows, 6, 3)


def test_empty_table_and_clashing_columns(spark):
    assert substring_dedup(spark.createDataFrame([], SHAPE)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "k", 9, 1, "p"), (2, "a b c d e f", "k", 9, 2, "q")], "doc_id long, text string, hash string, removed_words int, id int, words string")
    out = substring_dedup(df, 6, 3)
    assert sorted(out.columns) == sorted(df.columns)
    assert {(r.doc_id, r.text, r.hash, r.id, r.words) for r in out.collect()} == {(1, "a b c d e f", "k", 1, "p"), (2, "", "k", 2, "q")}
    assert spans(spark.createDataFrame([], SHAPE)).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()], 50, 25)


@pytest.mark.parametrize("seed", range(5))
def test_automaton_finds_every_match(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(3) for _ in range(rng.randint(3, 40))] for _ in range(4)]
    query = [rng.randrange(3) for _ in range(60)]
    grams = {tuple(t[i : i + 4]) for t in texts for i in range(len(t) - 3)}
    assert Automaton(texts).ends(query, 4) == [i for i in range(3, 60) if tuple(query[i - 3 : i + 1]) in grams]
