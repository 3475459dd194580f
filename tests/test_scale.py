"""Steps whose time or memory must not grow faster than the input: what they plan, and that short cuts change no result."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lamina.functions import language, segment, text
from lamina.operators import chunking, providers
from lamina.plans import fixtures, registry

SF = f"{DATA}/sf0.001"
ODD = [None, "", " ", " \n a\x1cb 　", "naïve Ünder", "пример", "\U0001F600 \U0001F600a", "كتاب", "كتاب a", "a كتاب كتاب b", "١٢٣ x", "٣", "a\x85b\x0bc  d\te", *fixtures.TEXTS]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["detect_segments", "sentences_fast", "language_runs"])
def test_parts_are_made_once(spark, name):
    """An inner explode was filtered by the size of its parts first, and languages were told inside a transform()."""
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert plan.count("split(") == 1
    assert not any("regexp_replace" in line and "lambda" in line for line in plan.split("\n"))


@pytest.mark.parametrize("name", ["estimate_tokens", "detect_script"])
def test_letters_are_taken_out_only_where_they_are_rare(spark, name):
    """Long runs of negated classes of several ranges, over all of a text, took most of the time."""
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert r"[^\x{600}" not in plan and r"[^\t" not in plan


def test_language_script_and_words_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    t = F.col("t")
    found = df.select(
        "i", language.detect_language(t).alias("l"), language.detect_script(t).alias("s"), text.count_words(t).alias("w"), text.strip(t).alias("b"), text.collapse_spaces(t).alias("c")
    )
    for r in found.collect():
        x = ODD[r.i]
        if x is None:
            assert (r.l, r.s, r.w, r.b, r.c) == ("unknown", "mixed", None, None, None)
            continue
        a, n = len(segment._SCRIPT.findall(x)), len(segment._LATIN.findall(x))
        assert r.l == segment.language(x), x
        assert r.s == ("mixed" if not a + n or 0.3 <= a / (a + n) <= 0.7 else "arabic" if a / (a + n) > 0.7 else "latin"), x
        assert (r.w, r.b, r.c) == (len(x.split()), x.strip(), text._BLANKS.sub(" ", x)), x


@pytest.mark.parametrize("name", ["html_chunks", "split_oversized", "merge_small", "sentences_routed", "chunk_structure_aware", "metrics_summary", "dedup_within", "document_info"])
def test_one_worker_a_task(spark, name):
    """Parsing and normalization had Python workers of their own, which took 10,000 rows at once."""
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_plain_normalization_is_that_of_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    for r in df.select("i", text.normalize_text(F.col("t")).alias("n")).collect():
        assert r.n == (None if ODD[r.i] is None else text.normalized(ODD[r.i])), ODD[r.i]


def test_rows_of_null_and_blank_texts(spark, monkeypatch):
    monkeypatch.setattr(chunking, "BITE", 1)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "A b. C"), (4, "D")], "doc_id long, text string").coalesce(1)
    assert [tuple(r) for r in chunking.split_rows(df, segment.fast).collect()] == [(3, 0, "A b."), (3, 1, "C"), (4, 0, "D")]
    info = {r.document_id: (r.language, r.total_chars) for r in chunking.document_info(df).collect()}
    assert info == {"2": ("unknown", 0), "3": ("en", 6), "4": ("en", 1)}
    read = chunking.chunk(df, column="text", read=lambda t: t.replace("D", "# E\n\nF"))
    assert [(r.document_id, r.text) for r in read.select("document_id", "text").collect()] == [("3", "A b.\n\nC"), ("4", "# E\n\nF")]


def test_hashed_words_stay_few_and_change_no_vector(monkeypatch):
    """A worker remembered 200,000 words, of any length."""
    texts = ["", "a b A", "long" * 20, *(f"w{i} w{i % 7} x" for i in range(1200))]
    want = providers.HashEmbedder(16).embed(texts)
    assert (np.vstack([providers.HashEmbedder(16).embed([t]) for t in texts]) == want).all()
    assert np.allclose(np.linalg.norm(want, axis=1)[1:], 1) and not want[0].any()
    monkeypatch.setattr(providers._Slots, "MOST", 5)
    providers._slots.cache_clear()
    assert (providers.HashEmbedder(16).embed(texts) == want).all() and len(providers._slots(16)) <= 5
    providers._slots.cache_clear()
