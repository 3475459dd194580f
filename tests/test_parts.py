"""Config, providers, readers, sinks, metrics, streaming and the front."""

import asyncio
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina import api, errors
from lamina.config import ChunkerConfig
from lamina.functions import text as tx
from lamina.operators import chunking, metrics, providers, vectors
from lamina.sources import readers, sinks
from lamina.streaming import stream

SHAPE = "doc_id long, text string"
SMALL = ChunkerConfig(strategy="sentence", chunk_size=20, min_chunk_size=5, max_chunk_size=30)


@pytest.mark.parametrize(
    "more",
    [
        {"chunk_size": 50}, {"chunk_overlap": 220}, {"threshold_amount": 0}, {"threshold_amount": 101}, {"strategy": "agentic"}, {"strategy": "nope"}, {"embedding_cache_size": -1},
        {"language_cache_size": -1}, {"persist_cache_to_disk": True}, {"batch_size": 0}, {"num_workers": 0}, {"max_retries": -1}, {"retry_backoff_factor": 0}, {"log_level": "LOUD"},
    ],
)
def test_bad_settings(more):
    with pytest.raises(ValueError, match="."):
        ChunkerConfig(**more).validate()


def test_settings():
    assert len(ChunkerConfig.names()) >= 50
    assert ChunkerConfig(strategy="fixed").validate().strategy_name == "fixed_size"
    with pytest.warns(UserWarning, match="similarity_metric"):
        ChunkerConfig(similarity_metric="dot_product").validate()
    assert ChunkerConfig(threshold_type="gradient", threshold_amount=500).validate()


def test_bucket_retry_fallback_and_breaker():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = providers.TokenBucket(60, clock=lambda: now[0], sleep=sleep)
    for _ in range(61):
        bucket.acquire()
    assert sum(slept) == pytest.approx(1.0)
    tries = []

    def fails_twice():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return 7

    slept.clear()
    assert providers.with_retry(fails_twice, sleep=sleep) == 7 and slept == [1.0, 2.0]
    with pytest.raises(KeyError):
        providers.with_retry(lambda: {}["x"], 1, sleep=sleep)
    assert providers.with_fallback(lambda: 1 / 0, lambda: 5) == 5
    with pytest.raises(errors.FallbackError):
        providers.with_fallback(lambda: 1 / 0, lambda: 1 / 0)
    with pytest.raises(errors.ChunkerException):
        providers.with_fallback(lambda: 1 / 0, None)
    breaker = providers.CircuitBreaker(2, 60, clock=lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker.call(lambda: 1 / 0)
    assert breaker.state == "open"
    with pytest.raises(errors.CircuitOpen):
        breaker.call(lambda: 1)
    now[0] += 61
    assert breaker.state == "half_open" and breaker.call(lambda: 3) == 3 and breaker.state == "closed"
    assert isinstance(errors.wrap(TimeoutError("x")), errors.TimeoutExceeded)


def test_chat_retries_and_then_refuses():
    calls, slept = [], []

    class Client:
        class chat:
            class completions:
                @staticmethod
                def create(**kw):
                    calls.append(kw)
                    raise ConnectionError

    c = ChunkerConfig(strategy="agentic", openai_api_key="k", max_retries=2, retry_backoff_factor=3.0)
    for _ in range(5):
        with pytest.raises(ConnectionError):
            providers.chat("text", c, Client, slept.append)
    assert len(calls) == 15 and slept[:2] == [1.0, 3.0]
    with pytest.raises(errors.CircuitOpen):
        providers.chat("text", c, Client, slept.append)
    providers.unload()
    with pytest.raises(ConnectionError):
        providers.chat("text", c.with_(retry_on_network_error=False), Client, slept.append)
    assert len(calls) == 16
    providers.unload()


def test_embedders():
    e = providers.HashEmbedder(32)
    v = e.embed(["a b", "a b", ""])
    assert v.shape == (3, 32) and np.allclose(v[0], v[1]) and np.linalg.norm(v[0]) == pytest.approx(1) and not v[2].any()
    assert e.get_dimension() == 32

    class Client:
        calls: list = []

        class embeddings:
            @staticmethod
            def create(model, input):
                Client.calls.append(input)
                return type("R", (), {"data": [type("D", (), {"index": i, "embedding": [float(len(t))]})() for i, t in enumerate(input)]})()

    p = providers.OpenAIEmbeddingProvider(client=lambda: Client, per_call=2)
    assert p.embed(["a", "  ", "ccc"]).tolist() == [[1.0], [1.0], [3.0]] and Client.calls == [["a", " "], ["ccc"]]
    with pytest.raises(errors.EmbeddingError):
        providers.embedder(ChunkerConfig(embedding_provider="custom"))
    assert providers.once("k", lambda: 4) == 4 and providers.once("k", lambda: 5) == 4 and "k" in providers.loaded()
    providers.unload()


PAGE = """<html><head><style>no</style></head><body><header>skip</header><h1>Ti<b>tle</b></h1><nav><ul><li>menu</ul></nav><p>One &amp; <i>two</i><p>Second<br>line
<ul><li>a<li><p>b</p></ul><table><tr><td>c<td>d</table><div>bare</div><form><p>f</p></form><h2></h2><blockquote><p>q</p></blockquote></body>"""


def test_html():
    assert readers.read_html(PAGE) == "\n\n".join(["# Ti tle\n", "One & two", "Second line", "a", "b", "b", "c", "d", "q", "q"])
    assert readers.read_html("") == "" and readers.read_html(None) is None and readers.read_html("<p>x") == "x"


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("OEBPS/a.xhtml", "<p>first</p>")
        z.writestr("OEBPS/b.xhtml", "<p>second</p>")
        z.writestr("OEBPS/c.xhtml", "<div> </div>")
        items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in "abc")
        z.writestr("OEBPS/book.opf", f'<package xmlns="x"><manifest>{items}</manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(PAGE.encode() + b"\xff")
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "a.txt").write_text("plain\ntext")
    assert [r.text for r in readers.html_files(spark, str(tmp_path)).collect()][0].startswith("# Ti tle")
    assert [r.text for r in readers.epub_files(spark, str(tmp_path)).collect()] == ["second\n\n---\n\nfirst"]
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    rows = {r.source_file.rpartition("/")[2]: r for r in readers.epub_files(spark, str(tmp_path), errors=True).collect()}
    assert rows["a.epub"].error is None and rows["bad.epub"].text is None and "BadZipFile" in rows["bad.epub"].error
    with pytest.raises(Exception, match="BadZipFile"):
        readers.epub_files(spark, str(tmp_path)).collect()
    assert "plain\ntext" in [r.text for r in readers.text_files(spark, str(tmp_path / "a.txt")).collect()]
    with pytest.raises(Exception, match="(?i)exist|found"):
        readers.html_files(spark, str(tmp_path / "none")).collect()
    if readers.pdf_backend() is None:
        assert readers.read_pdf_pages(b"") == []
        with pytest.raises(errors.DependencyError):
            readers.read_pdf(b"")


def test_chunk_rows(spark):
    rows = [(1, "One two three four. Five six seven. " * 10), (2, None), (3, ""), (4, "  \n"), (1, "Again the same id. And more text here.")]
    df = spark.createDataFrame([(*r, "f.txt", {"k": "v"}, 5) for r in rows], SHAPE + ", source_file string, custom map<string,string>, normalized int")
    found = chunking.chunk(df, SMALL, extra={"x": 1}).collect()
    assert {r.document_id for r in found} == {"1"}
    assert all(r.source_file == "f.txt" and r.custom == {"k": "v", "x": "1"} and r.strategy == "sentence" and r.language == "en" for r in found)
    assert all(r.char_count == len(r.text) and r.token_count == max(1, len(r.text) // 3) for r in found)
    assert chunking.chunk(df.limit(0), SMALL).count() == 0
    d = json.loads(chunking.to_dict(chunking.chunk(df, SMALL)).first().json)
    assert set(d) == {"text", "content_hash", "metadata", "embedding"} and len(d["metadata"]) == 23


def test_semantic_falls_back_and_tells(spark):
    class Broken(providers.Base):
        model = "broken"

        def embed(self, texts):
            raise RuntimeError

    df = spark.createDataFrame([(1, "One two three. " * 60)], SHAPE)
    assert {r.strategy for r in chunking.chunk(df, ChunkerConfig(strategy="semantic"), provider=Broken()).collect()} == {"recursive"}
    with pytest.raises(Exception, match="RuntimeError"):
        chunking.chunk(df, ChunkerConfig(strategy="semantic", enable_fallbacks=False), provider=Broken()).collect()
    scored = chunking.chunk(df, ChunkerConfig(strategy="sentence", compute_coherence_score=True, embedding_provider="hash")).collect()
    assert all(r.coherence_score == pytest.approx(1.0) for r in scored)


def test_embeddings_and_their_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], SHAPE)
    e = chunking.embed(df)
    got = {r.doc_id: r.embedding for r in e.collect()}
    assert got[1] == got[2] and got[3] is None and len(got[4]) == 256
    path = str(tmp_path / "cache")
    sinks.save_embeddings(e, "hash", path)
    sinks.save_embeddings(e, "hash", path)
    cache = sinks.load_embeddings(spark, path)
    assert cache.count() == 2

    class Never(providers.HashEmbedder):
        def embed(self, texts):
            raise AssertionError

    assert {r.doc_id for r in chunking.embed(df, Never(), cache=cache).filter("embedding is not null").collect()} == {1, 2, 4}
    s = sinks.cache_stats(df, cache, "hash").first()
    assert (s.embedding_hits, s.embedding_misses, s.embedding_hit_rate, s.embedding_cache_size) == (3, 0, 1.0, 2)
    with pytest.raises(OSError, match="pickled"):
        sinks.load_embeddings(spark, "x.pkl")


@pytest.mark.parametrize(("store", "size"), [("chroma", 2), ("pinecone", 2), ("qdrant", 2)])
def test_stores(spark, tmp_path, store, size):
    out = str(tmp_path)

    class Client:
        """As strict as the stores are: ids of Qdrant are UUIDs, and a vector is there for every row or for none."""

        def upsert(self, **kw):
            import os
            import pathlib
            import uuid

            for p in kw.get("points", ()):
                assert str(uuid.UUID(p["id"])) == p["id"] and p["payload"]["chunk_id"]
            assert all(len(kw.get(k, kw["ids"])) == len(kw["ids"]) and None not in kw.get(k, ()) for k in ("embeddings", "documents", "metadatas") if "ids" in kw)
            pathlib.Path(out, f"{os.getpid()}-{uuid.uuid4().hex}").write_text(json.dumps(kw))

    chunks = chunking.embed(chunking.chunk(spark.createDataFrame([(1, "One two three four five. " * 40)], SHAPE), SMALL)).coalesce(1)
    n = chunks.count()
    sinks.write(chunks, store, Client, "space", size)
    sent = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    counts = [len(s.get("ids") or s.get("vectors") or s.get("points")) for s in sent]
    assert sum(counts) == n and max(counts) == size
    if store != "chroma":
        with pytest.raises(ValueError, match="embedding"):
            sinks.write(chunks.drop("embedding"), store, Client)
        with pytest.raises(Exception, match="no embedding"):
            sinks.write(chunks.withColumn("embedding", F.lit(None).cast("array<float>")), store, Client)
    else:
        for p in tmp_path.iterdir():
            p.unlink()
        sinks.write(chunks.withColumn("embedding", F.when(F.col("chunk_index") % 2 == 1, F.col("embedding"))), store, Client, batch_size=4)
        sent = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
        assert sum(len(s["ids"]) for s in sent) == n and sum(len(s.get("embeddings", ())) for s in sent) == n // 2
    found = sinks.search(chunks, chunks.first().embedding, 1).first()
    assert found.score == pytest.approx(1.0, abs=1e-5)


def test_metrics_and_log(spark):
    m = metrics.MetricsCollector()
    m.record_document_processed("d", "en", "sentence", 10.0, 3, 30)
    m.record_document_processed("e", "ar", "sentence", 30.0, 1, 5)
    m.record_embedding_call("m", 4, 1.0)
    m.record_embedding_call("m", 12, 1.0, cache_hit=True)
    m.record_cache_access("language", True)
    m.record_error("X", True)
    m.record_error("Y", False)
    s = m.get_summary()
    assert (s["documents_processed"], s["total_chunks_created"], s["avg_processing_time_ms"], s["min_processing_time_ms"]) == (2, 4, 20.0, 10.0)
    assert s["embedding_cache_hit_rate"] == 0.75 and s["fallbacks_triggered"] == 1 and s["total_errors"] == 2 and s["embedding_calls"] == 2
    assert 'lamina_strategy_usage_total{strategy="sentence"} 2' in m.export_prometheus()
    off = metrics.MetricsCollector(False)
    off.record_error("X", True)
    assert off.export_prometheus() == "" and off.get_summary()["total_errors"] == 0
    m.reset()
    assert m.get_summary()["documents_processed"] == 0
    line = metrics.StructuredLogger().language_detected("d", "en")
    assert json.loads(line)["event"] == "language_detected" and json.loads(line)["confidence"] == 1.0
    assert metrics.StructuredLogger(False).cache_hit("e", "k").startswith("[cache_hit] ")
    runs = metrics.runs_of(chunking.chunk(spark.createDataFrame([(1, "One two. " * 50)], SHAPE), SMALL))
    assert json.loads(metrics.log_events(runs).first().json)["strategy"] == "sentence"
    of = spark.createDataFrame([(str(i), "en", "sentence", 2, 9, t) for i, t in enumerate([10.0, 30.0, None])], "document_id string, language string, strategy string, chunk_count int, token_count int, duration_ms double")
    m.record_document_processed("d", "en", "fixed", 20.0, 3, 30)
    m.record_runs(of)
    s = m.get_summary()
    assert (s["documents_processed"], s["total_processing_time_ms"], s["min_processing_time_ms"], s["max_processing_time_ms"]) == (4, 60.0, 10.0, 30.0)
    assert s["strategy_usage"] == {"fixed": 1, "sentence": 3}


def test_streams_give_what_batches_give(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Document {i} has words. And some more of them. " * 8) for i in range(20)], SHAPE)
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    q = stream.write_stream(stream.chunk_stream(stream.read_stream(spark, str(tmp_path / "in"), SHAPE, 2), SMALL), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    want = chunking.chunk(docs, SMALL).select("chunk_id")
    got = spark.read.parquet(str(tmp_path / "out")).select("chunk_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    heard = []
    pairs = list(stream.with_progress(docs, SMALL, lambda a, b: heard.append((a, b))))
    assert len(pairs) == 20 and heard[-1] == (20, 20) and [c.chunk_index for c in pairs[0][1]] == list(range(len(pairs[0][1])))


def test_stateful_streams(spark, tmp_path):
    shape = SHAPE + ", at timestamp"
    spark.sql("select 1L doc_id, 'Same text. Really.' text, timestamp'2024-01-01 00:00:00' at union all select 2L, 'Same text. Really.', timestamp'2024-01-01 00:05:00'").write.parquet(str(tmp_path / "in"))
    source = stream.read_stream(spark, str(tmp_path / "in"), shape).withColumn("content_hash", tx.content_hash(F.col("text")))
    q = stream.write_stream(stream.deduplicate_stream(source, "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_front(spark):
    c = api.SemanticChunker(spark, SMALL)
    out = c.chunk_batch(["Valid document here. " * 10, "", "Another valid document. " * 10], ["a.txt"])
    assert [len(x) > 0 for x in out] == [True, False, True]
    assert out[0][0].source_file == "a.txt" and out[2][0].source_file == ""
    assert c.chunk("Hello there.", document_id="z", extra_metadata={"k": 1})[0].document_id == "z"
    with pytest.raises(errors.InputValidationError):
        c.chunk(None)
    assert c.metrics.get_summary()["documents_processed"] == 4
    stats = c.get_stats(c.table(spark.createDataFrame([(1, "Valid document here. " * 10)], SHAPE))).first()
    assert stats.total_chunks >= 1 and stats.language_distribution == {"en": stats.total_chunks} and stats.strategy == "sentence"
    assert asyncio.run(api.AsyncSemanticChunker(spark, SMALL).chunk("Hi there. You."))[0].text == "Hi there. You."
    api.custom("halves", lambda sentences, text, config: [text[: len(text) // 2], text[len(text) // 2 :]])
    assert [r.text for r in api.SemanticChunker(spark, ChunkerConfig(strategy="halves")).chunk("abcd")] == ["ab", "cd"]
    api.register_sql(spark, SMALL)
    spark.createDataFrame([(1, "One two. " * 60)], SHAPE).createOrReplaceTempView("some_docs")
    assert spark.sql("select d.doc_id, c.text from some_docs d, lateral chunk_text(d.text) c").count() > 1
    odd = spark.createDataFrame([(1, "Hello    world\x01. " * 30), (2, None), (3, " \n"), (4, "e\u0301te\u0301\n\n\n\n\u00a0x. " * 30)], SHAPE)
    odd.createOrReplaceTempView("odd_docs")
    got = spark.sql("select string(d.doc_id) document_id, c.* from odd_docs d, lateral chunk_text(d.text) c")
    want = chunking.chunk(odd, SMALL).select("document_id", "chunk_index", "start_char", "end_char", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_search_over_many_queries_without_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    want = sorted(tuple(r) for r in vectors.search_many(v, q, 3).collect())
    monkeypatch.setattr(vectors, "QUERIES", 2)
    assert sorted(tuple(r) for r in vectors.search_many(v, q, 3).collect()) == want
    assert all(r[2] == r[0] for r in want if r[1] == 1)
