"""Chunking of streams. It keeps no state, so any output mode and any source will do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lamina.config import ChunkerConfig
from lamina.operators.chunking import chunk


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunk_stream(docs: DataFrame, config: ChunkerConfig = ChunkerConfig(), **more) -> DataFrame:
    """Chunks of a stream of documents: the same plan as in batch."""
    return chunk(docs, config, **more)


def deduplicate_stream(chunks: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """First chunk of each text to arrive within ``delay``; the watermark bounds what is remembered."""
    return chunks.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(chunks: DataFrame, time: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Chunks and tokens by language and event-time window."""
    return (
        chunks.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("window"), "language")
        .agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    )


def write_stream(chunks: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """Starts writing to Parquet at ``path``, or through ``each`` batch; takes what is there and ends."""
    writer = chunks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(each).start() if each else writer.format("parquet").outputMode("append").start(path)


def iterate(chunks: DataFrame) -> Iterator[Row]:
    """Chunks one after another, a partition in the driver's memory at a time."""
    yield from chunks.toLocalIterator(prefetchPartitions=True)


def with_progress(docs: DataFrame, config: ChunkerConfig = ChunkerConfig(), callback: Callable[[int, int], None] | None = None, **more) -> Iterator[tuple[str, list[Row]]]:
    """(document_id, chunks) of each document that has any, ordered by document_id; ``callback`` hears how many are done, of how many."""
    total = docs.count() if callback else 0
    found = chunk(docs, config, **more)
    # Chunks hold a map, which has no order; their index does.
    ordered = F.array_sort(F.collect_list(F.struct(*found.columns)), lambda a, b: a["chunk_index"] - b["chunk_index"])
    grouped = found.groupBy("document_id").agg(ordered.alias("c"))
    for done, r in enumerate(grouped.orderBy("document_id").toLocalIterator(), 1):
        if callback:
            callback(done, total)
        yield r["document_id"], list(r["c"])
