"""The library's front: a chunker for lists of texts, files and tables, also from SQL and asyncio."""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from lamina.config import ChunkerConfig
from lamina.errors import InputValidationError
from lamina.functions.text import normalized
from lamina.operators import chunking, corpus
from lamina.operators.metrics import MetricsCollector, StructuredLogger, runs_of, timer
from lamina.operators.providers import Provider, chat, embedder
from lamina.sources import readers
from lamina.streaming import stream


class SemanticChunker:
    """Chunks by one config on one session. Tables stay distributed; lists come back as lists of rows."""

    def __init__(self, spark: SparkSession, config: ChunkerConfig | None = None, provider: Provider | None = None, ask: Callable | None = None):
        self.spark, self.config = spark, config or ChunkerConfig()
        if self.config.strategy not in chunking._CUSTOM:
            self.config.validate()
        self.provider, self.ask = provider, ask
        self.metrics = MetricsCollector(self.config.enable_metrics)
        self.log = StructuredLogger(self.config.enable_structured_logging, self.config.log_level)

    def table(self, docs: DataFrame, document_id: str = "doc_id", column: str = "text", extra: dict | None = None) -> DataFrame:
        """Chunks of a table of documents."""
        return chunking.chunk(docs, self.config, document_id, column, self.provider, self.ask, extra)

    def chunk_batch(self, texts: list[str], source_files: list[str] | None = None, document_ids: list[str] | None = None, extra_metadata: dict | None = None) -> list[list[Row]]:
        """Chunks of each text, in the order of the texts; blank texts have none."""
        for t in texts:
            if not isinstance(t, str):
                raise InputValidationError(f"a document must be a string, got {type(t).__name__}")
        if not texts:
            return []
        docs = readers.in_memory(self.spark, texts, source_files)
        with timer() as t:
            rows = self.table(docs, extra=extra_metadata).orderBy("document_id", "chunk_index").collect()
        out: list[list[Row]] = [[] for _ in texts]
        for r in rows:
            i = int(r["document_id"])
            name = document_ids[i] if document_ids else r["document_id"]
            out[i].append(Row(**{**r.asDict(), "document_id": name}))
        for i, own in enumerate(out):
            first = own[0] if own else None
            self.metrics.record_document_processed(
                str(i), first["language"] if first else "unknown", self.config.strategy_name, t.ms / len(out), len(own), sum(r["token_count"] for r in own)
            )
        self.log.chunking_complete("batch", t.ms, len(rows), self.config.strategy_name)
        return out

    def chunk(self, text: str, source_file: str = "", document_id: str = "", extra_metadata: dict | None = None) -> list[Row]:
        return self.chunk_batch([text], [source_file], [document_id or "0"], extra_metadata)[0]

    def chunk_stream(self, text: str, **more) -> Iterator[Row]:
        yield from self.chunk(text, **more)

    def process_with_progress(self, docs: DataFrame, callback: Callable[[int, int], None] | None = None) -> Iterator[tuple[str, list[Row]]]:
        return stream.with_progress(docs, self.config, callback, provider=self.provider, ask=self.ask)

    def record(self, chunks: DataFrame) -> None:
        """Takes the totals of a distributed run into the metrics."""
        self.metrics.record_runs(runs_of(chunks))

    @staticmethod
    def get_stats(chunks: DataFrame) -> DataFrame:
        return corpus.get_stats(chunks)

    @staticmethod
    def to_dicts(chunks: DataFrame) -> DataFrame:
        return chunking.to_dict(chunks)

    @staticmethod
    def to_texts(chunks: DataFrame) -> DataFrame:
        return chunks.select("text")


class AsyncSemanticChunker:
    """The same, for asyncio: jobs are waited for in threads."""

    def __init__(self, *args, **kwargs):
        self.chunker = SemanticChunker(*args, **kwargs)

    async def chunk(self, text: str, **more) -> list[Row]:
        return await asyncio.to_thread(self.chunker.chunk, text, **more)

    async def chunk_batch(self, texts: list[str], **more) -> list[list[Row]]:
        return await asyncio.to_thread(self.chunker.chunk_batch, texts, **more)

    async def chunk_stream(self, text: str, **more):
        for r in await self.chunk(text, **more):
            yield r


def register_sql(
    spark: SparkSession, config: ChunkerConfig | None = None, name: str = "chunk_text", provider: Provider | None = None, ask: Callable | None = None
) -> None:
    """Makes ``name(text)`` a table function for SQL, of the chunks and offsets that ``chunk`` gives: SELECT c.* FROM docs, LATERAL chunk_text(docs.text) c."""
    from pyspark.sql.functions import udtf

    chosen = config or ChunkerConfig()
    chosen.validate()
    if chosen.strategy == "semantic" or chosen.compute_coherence_score:
        provider = provider or embedder(chosen)
    if chosen.strategy == "agentic":
        ask = ask or chat

    @udtf(returnType="chunk_index: int, start_char: int, end_char: int, text: string")
    class ChunkText:
        def eval(self, text: str):
            if text:
                for p in chunking.chunk_text(normalized(text), chosen, provider, ask, counts=False)["pieces"]:
                    yield p["chunk_index"], p["start_char"], p["end_char"], p["text"]

    spark.udtf.register(name, ChunkText)


def custom(name: str, strategy: Callable[[list[str], str, ChunkerConfig], list[str]]) -> None:
    """Registers a strategy of one's own, for ``ChunkerConfig(strategy=name)``."""
    chunking.register(name, strategy)


