"""Line dedup against a brute-force version."""

import random
from collections import Counter

from lamina.llm.line_dedup import line_dedup

SHAPE = "doc_id long, source string, text string"
WS = " \t\r\f\x0b"


def brute(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for _, host, text in rows:
        if host is None:
            continue
        pages[host] += 1
        if text is not None:
            seen.update((host, x) for x in {line.strip(WS) for line in text.split("\n")} if x)
    gone = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return [(i, h, t if t is None or h is None else "\n".join(x for x in t.split("\n") if (h, x.strip(WS)) not in gone)) for i, h, t in rows]


def same(spark, rows, ratio=0.3, least=3):
    out = [tuple(r) for r in line_dedup(spark.createDataFrame(rows, SHAPE), ratio=ratio, min_pages=least).collect()]
    assert sorted(out, key=repr) == sorted(brute(rows, ratio, least), key=repr)


def test_random_pages(spark):
    rng = random.Random(4)
    lines = [f"line {i}" for i in range(15)] + ["", "  ", " line 1 ", "\tline 2"]
    same(spark, [(i, rng.choice("abc"), "\n".join(rng.choices(lines, k=rng.randint(1, 6)))) for i in range(80)])


def test_odd_rows(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, "a", "x"), (3, "a", "x"), (3, "a", "x\n\ny"), (None, "a", " x "), (5, None, "x"), (6, None, "x"), (7, "b", "\n".join(["x", "long " * 50_000]))]
    same(spark, rows)
    # A line on exactly the ratio stays; one beyond goes.
    same(spark, [(i, "h", "tie" if i < 3 else "other") for i in range(10)], 0.3, 3)
    same(spark, [(i, "h", "over" if i < 4 else "other") for i in range(10)], 0.3, 3)
    assert line_dedup(spark.createDataFrame([], SHAPE)).count() == 0


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(i, "h", "x\ny%d" % i, i, "l") for i in range(6)], "doc_id long, source string, text string, n long, host string")
    out = line_dedup(df)
    assert out.columns == df.columns
    assert {(r.doc_id, r.text, r.n, r.host) for r in out.collect()} == {(i, f"y{i}", i, "l") for i in range(6)}
