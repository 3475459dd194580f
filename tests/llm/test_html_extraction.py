"""HTML extraction: gradients, blocks, and held-out accuracy of the labels."""

import html
import random
import re
import time

import numpy as np
import pytest
from conftest import DATA

from lamina.llm import html_extraction as h

SHAPE = "page_id long, html string"


def test_gradients():
    rng = np.random.default_rng(0)
    model = h.Labeller(5, 3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    lengths = np.array([4, 2])
    x = rng.standard_normal((4, 2, 5))
    y, weight = (rng.random((4, 2)) > 0.5).astype(float), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], dtype=float)
    _, grads = model.gradients(x, y, weight, lengths)
    for k, v in model.p.items():
        for i in rng.integers(0, v.size, 5):
            old = v.flat[i]
            loss = []
            for e in (1e-4, -1e-4):
                v.flat[i] = old + e
                loss.append(model.gradients(x, y, weight, lengths)[0])
            v.flat[i] = old
            assert abs((loss[0] - loss[1]) / 2e-4 - grads[k].flat[i]) < 2e-3, k


def test_padding_changes_nothing():
    pages = [h.blocks("<p>a b</p>" * n) for n in (1, 7, 30)]
    model = h.Labeller(h.PATH + h.WORDS + h.NUMBERS)
    together = h.label(model, pages)
    assert all(np.allclose(a, h.label(model, [p])[0], atol=1e-5) for a, p in zip(together, pages))


def test_blocks():
    page = "<html><head><title>no</title></head><body><nav><ul><li><a href=x>Home</a><li>Two</ul></nav><p>One <b>bold</b><p>Second<br>line &amp; more<script>if(a<b){}</script></body>"
    found = h.blocks(page)
    assert [b.text for b in found] == ["Home", "Two", "One bold", "Second", "line & more"]
    assert found[0].linked == 1 and found[2].linked == 0
    assert "nav" in found[0].path and "p" in found[3].path
    assert h.blocks("") == [] and h.blocks("<<<") and h.blocks("plain")[0].text == "plain"
    assert [b.text for b in h.blocks("<html><head><title>T</title><body><p>Hello world</p><div><div><p>deep</p>")] == ["Hello world", "deep"]
    assert [b.text for b in h.blocks("<head><title>T</title> loose <p>x")] == ["loose", "x"]
    assert h.blocks("<p title='a > b'>x</p>")[0].text == "x"
    # What can't be a tag is text.
    assert h.blocks("<p>open <a href='")[0].text == "open < a href='"


def plain(page):
    """(path, text) of each block, with a stack that is searched and copied."""
    out, stack, parts = [], [], []

    def flush():
        text = " ".join(" ".join(parts).split())
        if text:
            out.append((tuple(x for t, names in stack if t not in h._INLINE for x in (t, *("." + n for n in names))), text))
        parts.clear()

    at = 0
    token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", re.S)
    while m := token.match(page, at):
        at = m.end()
        closing, tag, rest, text = m.groups()
        if text is not None:
            if any(t == "head" for t, _ in stack) and not any(t == "title" for t, _ in stack) and text.strip():
                del stack[[t for t, _ in stack].index("head") :]
            if not any(t in ("head", "title") for t, _ in stack):
                parts.append(html.unescape(text))
        elif tag is not None:
            tag = tag.lower()
            if tag in h._RAW and not closing:
                stop = h._RAW[tag].search(page, at)
                at = stop.end() if stop else len(page)
                continue
            if tag == "br" or tag not in h._INLINE:
                flush()
            if not closing and tag not in h._HEAD and any(t == "head" for t, _ in stack):
                del stack[max(i for i, (t, _) in enumerate(stack) if t == "head") :]
            if tag in h._VOID:
                continue
            if closing:
                if tag in [t for t, _ in stack]:
                    del stack[max(i for i, (t, _) in enumerate(stack) if t == tag) :]
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in h._CLOSES.get(tag, ()):
                        del stack[i:]
                        break
                    if stack[i][0] not in h._INLINE:
                        break
                stack.append((tag, [n for f in h._CLASS.findall(rest) for x in f for n in x.split()]))
    flush()
    return out


@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_those_of_a_plain_parser(seed):
    rng = random.Random(seed)
    bits = [
        "<p>", "</p>", "<div class='a b'>", "</div>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<a href=\"x>y\">", "</a>", "<br>", "<td>", "<tr>", "<table>", "</table>", "<head>", "</head>",
        "<title>", "</title>", "<body>", "word ", "more &amp; ", "<", ">", "'", '"', "<!-- c <p> -->", "<!doctype x>", "<script>x<p></script>", "<a b='", "<meta x>", " ", "<article id=m>", "</article>", "</x>", "<img src=a>",
    ]
    for _ in range(400):
        page = "".join(rng.choices(bits, k=rng.randint(1, 25)))
        assert [(b.path, b.text) for b in h.blocks(page)] == plain(page), page
    for page in ("<head>" * 3 + "x", "<title><title>a</title>b"):
        assert [(b.path, b.text) for b in h.blocks(page)] == plain(page)


@pytest.mark.parametrize(
    "page",
    ["<a " * 100_000, "<div>x" * 50_000, "<a \"<a '" * 50_000, "<a \"" * 100_000 + ">", "<!" * 100_000, "<b>" * 30_000 + "<p></p>" * 30_000, "<div>" * 50_000 + "</x>" * 50_000, "<script " * 50_000, "<!--" * 50_000],
)
def test_time_follows_the_length(page):
    began = time.perf_counter()
    h.blocks(page)
    assert time.perf_counter() - began < 10


def test_held_out_accuracy_without_the_tags_that_gave_the_labels(spark):
    pages = [r.html for r in spark.read.parquet(f"{DATA}/sf0.1/pages.parquet").select("html").collect()]
    model = h.train(pages[:300])
    right = total = 0
    for page in pages[300:700]:
        found = h.blocks(page)
        y = [h.silver(b) for b in found]
        if not any(v is not None for v in y):
            continue
        x, lengths = h._padded([h.vectors(found, hidden=True)])
        p = model.forward(x, lengths)[0][:, 0]
        known = [i for i, v in enumerate(y) if v is not None]
        right += sum((p[i] >= h.KEEP) == bool(y[i]) for i in known)
        total += len(known)
    assert total > 500 and right / total >= 0.95, (right, total)


def test_odd_rows(spark):
    page = "<body><nav><li>Home</nav><article><h1>T</h1><p>Text of the article, with words.</article></body>"
    df = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, page, "u"), (3, page, "u"), (4, "<p>" + "word " * 50_000, "u"), (5, "<<>>", "u")], SHAPE + ", text string")
    out = h.extract(df)
    assert out.columns == ["page_id", "text", "n_blocks", "n_content"]
    rows = out.collect()
    assert [r.text for r in rows if r.page_id == 1] == [None] and [r.n_blocks for r in rows if r.page_id == 1] == [0]
    assert [r.text for r in rows if r.page_id == 2] == [""]
    assert len({r.text for r in rows if r.page_id == 3}) == 1 and len(rows) == 6
    assert h.extract(df.limit(0)).count() == 0


def test_sample_is_of_the_least_hashes(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.1/pages.parquet")
    want = [r.html for r in pages.selectExpr("html", "xxhash64(html) h").orderBy("h").limit(50).collect()]
    assert h._sample(pages, "html", 50) == want
    copies = spark.range(3000).selectExpr("'<p>same' html")
    assert h._sample(copies, "html", 20) == ["<p>same"] * 20
    assert h._sample(copies.limit(5), "html", 20) == ["<p>same"] * 5 and h._sample(copies.limit(0), "html") == []


def test_query_gives_the_blocks_that_the_model_keeps(spark):
    """Every page of a table, against one parsed plainly and labelled alone."""
    sf = f"{DATA}/sf0.001"
    rows = h.op6_html_extraction(spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    model = h.train(h._sample(spark.read.parquet(f"{sf}/pages.parquet"), "html"))
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        found = h.blocks(pages[r.page_id])
        p = h.label(model, [found])[0]
        texts = [t for _, t in plain(pages[r.page_id])]
        assert r.n_blocks == len(texts)
        if (abs(p - h.KEEP) > 1e-4).all():
            assert r.text == "\n".join(t for t, q in zip(texts, p) if q >= h.KEEP) and r.n_content == sum(p >= h.KEEP)
