"""The pipeline: each stage alone, the whole against the stages' plain versions, odd rows."""

from collections import Counter

import corpus_pipeline
import tiktoken
from conftest import DATA
from test_line_dedup import brute as lines_left
from test_ngram_join import survivors
from test_quality_rules import em, plain, vote

from lamina.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from lamina.llm.bpe import PATTERN, VOCABULARY, read_ranks
from lamina.llm.stats import FIELDS

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def test_whole_small_table(spark):
    sf = f"{DATA}/sf0.001"
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    p = em([vote(dict(zip(FIELDS, plain(t)))) for _, _, t in rows])
    rows = [r for r, x in zip(rows, p) if x >= quality_rules.KEEP]
    rows = lines_left(rows, line_dedup.RATIO, line_dedup.MIN_PAGES)
    stay = survivors([(i, t) for i, _, t in rows], ngram_join.THETA)
    rows = [r for r in rows if r[0] in stay]
    sizes = Counter(s for _, s, _ in rows)
    weight = {s: n**mixing.DAMPING for s, n in sizes.items()}
    coder = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})
    ids = {i: coder.encode_ordinary(t) for i, _, t in rows}
    source = {i: s for i, s, _ in rows}
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == len(rows)
    by, times = Counter(), Counter()
    for r in out:
        assert r.round_trip and list(r.ids) == ids[r.doc_id] and r.source == source[r.doc_id]
        by[r.source] += 1
        times[r.doc_id] += 1
    for s, w in weight.items():
        e = len(rows) * w / sum(weight.values())
        assert abs(by[s] - e) < 1
        for i, own in source.items():
            if own == s:
                assert int(e / sizes[s]) <= times[i] <= int(e / sizes[s]) + 1


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (None, "the cat is on the mat and it is happy", "en", None, 9), (3, "the cat is on the mat and it is happy", None, "a", 9),
        (3, "the cat is on the mat and it is happy", None, "a", 9), (4, "the of and to in " * 30_000, "en", "b", 1),
    ]
    for data in (rows, []):
        docs = spark.createDataFrame(data, SHAPE).selectExpr("*", "n_chars as copies", "lang as p_quality", "doc_id as ids")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
            assert data or out.count() == 0
            docs = out
        assert docs.count() <= len(rows)


def test_each_stage_gives_memory_back_first(spark):
    """Heaps are collected before each stage, and a worker drops its vocabulary and remembered words."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    docs = spark.createDataFrame([(1, "the cat is on the mat", "en", "a", 9)], SHAPE)
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, "")
        assert full() > before
    bpe.load(VOCABULARY).encode("some words")
    bpe.forget()
    assert not bpe._LOADED
