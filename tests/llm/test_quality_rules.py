"""Quality rules: the statistics and the estimates against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest
from conftest import DATA

from lamina.llm import quality_rules as q
from lamina.llm.stats import FIELDS, STOP_WORDS, measure

SHAPE = "doc_id long, text string"


def plain(text):
    w = (text or "").split()
    t = text or ""
    n, c = max(len(w), 1), max(len(t), 1)
    letters = [x for x in t if x.isascii() and x.isalpha()]
    threes = list(zip(w, w[1:], w[2:]))
    symbol = lambda x: 32 < ord(x) < 127 and not x.isalnum() and x not in ".,;:'\"()-?!|"
    return [
        len(w), len(t), t.count("\n") + (len(t) > 0), sum(map(len, w)) / n, sum(x.isupper() for x in letters) / max(len(letters), 1),
        sum(x in "0123456789" for x in t) / c, sum(map(symbol, t)) / c, t.count("!") / n, t.count("|") / n, sum(x in STOP_WORDS for x in w) / n,
        sum(a == b for a, b in zip(w, w[1:])) / n, 1 - len(set(threes)) / len(threes) if threes else 0.0, len(set(w)) / n if w else 0.0,
    ]


TEXTS = [None, "", " \n ", "word", "The cat and the cat and the cat", "SHOUT!!! NOW!!! | a | b", "été à Noël, 12 % #$", "a\nb\nc\n", "x " * 3000]


def test_statistics(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("text").collect()]
    assert np.allclose(measure(texts), [plain(t) for t in texts])
    assert len(FIELDS) == len(plain(""))


def em(votes, rounds=q.ITERATIONS):
    """Row by row, without patterns."""
    good = [1 / (1 + math.exp(-q.TRUST * (sum(v) - 3 * v.count(-1)))) for v in votes]
    for _ in range(rounds):
        weight = [[1 - g for g in good], good]
        prior = (sum(good) + q.SMOOTHING) / (len(votes) + 2 * q.SMOOTHING)
        table = []
        for c in (0, 1):
            table.append([])
            for r in range(len(q.RULES)):
                n = {x: q.SMOOTHING for x in (-1, 0, 1)}
                for v, w in zip(votes, weight[c]):
                    n[v[r]] += w
                table[c].append({x: n[x] / sum(n.values()) for x in n})
        now = []
        for v in votes:
            log = [math.log(p) + sum(math.log(table[c][r][x]) for r, x in enumerate(v)) for c, p in ((0, 1 - prior), (1, prior))]
            now.append(1 / (1 + math.exp(min(700, log[0] - log[1]))))
        change = max(abs(a - b) for a, b in zip(now, good))
        good = now
        if change < 1e-9:
            break
    return good


def vote(s):
    out = []
    for _, bad, good in q.RULES:
        test = lambda e: eval(e.replace("word_length between 3 and 10", "3 <= word_length <= 10"), {}, s)  # noqa: E731, S307
        out.append(-1 if test(bad) else 1 if good and test(good) else 0)
    return out


def test_posteriors_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = em([vote(dict(zip(FIELDS, plain(r.text)))) for r in rows])
    got = {r.doc_id: r.p_quality for r in q.score(docs).select("doc_id", "p_quality").collect()}
    assert all(abs(got[r.doc_id] - p) < 1e-6 for r, p in zip(rows, want))
    kept = {r.doc_id for r in q.op2_quality_rules(spark, f"{DATA}/sf0.001").collect()}
    assert kept == {r.doc_id for r, p in zip(rows, want) if p >= q.KEEP}


def test_agreement_with_labels(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    rows = q.score(docs).join(labels, "doc_id").select("p_quality", "quality").collect()
    kept = Counter((r.quality, r.p_quality >= q.KEEP) for r in rows if r.quality is not None)
    right = (kept[1, True] + kept[0, False]) / sum(kept.values())
    assert kept[1, True] / (kept[1, True] + kept[1, False]) >= 0.97, kept
    assert right >= 0.9, kept


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 0.5, "s") for i, t in enumerate(TEXTS + TEXTS)], SHAPE + ", p_quality double, stats string")
    out = q.score(df)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == 2 * len(TEXTS)
    got = {r.doc_id: r.p_quality for r in out.collect()}
    assert all(got[i] == pytest.approx(got[i + len(TEXTS)]) and 0 <= got[i] <= 1 for i in range(len(TEXTS)))
    assert got[0] == pytest.approx(got[1])
    assert q.score(spark.createDataFrame([], SHAPE)).count() == 0
