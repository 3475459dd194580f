"""Operators across chunks and documents: language runs, deduplication, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def language_boundaries(sentences: DataFrame, doc: str, pos: str, language: str = "language") -> DataFrame:
    """(doc, start, end, language): maximal runs of one language; positions count from 0, the end is exclusive."""
    w = Window.partitionBy(doc).orderBy(pos)
    placed = sentences.select(doc, F.col(language).alias("language"), (F.row_number().over(w) - 1).alias("i"), F.lag(language).over(w).alias("before"))
    starts = F.when(F.col("before").eqNullSafe(F.col("language")) & (F.col("i") > 0), 0).otherwise(1)
    run = placed.withColumn("run", F.sum(starts).over(Window.partitionBy(doc).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(doc, "run", "language").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end")).select(doc, "start", "end", "language")


def deduplicate(chunks: DataFrame, doc: str = "document_id", index: str = "chunk_index") -> DataFrame:
    """First chunk of each text within its document."""
    w = Window.partitionBy(doc, "content_hash").orderBy(index)
    return chunks.withColumn("__lamina_n", F.row_number().over(w)).filter("__lamina_n = 1").drop("__lamina_n")


def deduplicate_batch(chunks: DataFrame, order: str = "document_id", index: str = "chunk_index") -> DataFrame:
    """First chunk of each text in all documents, by document and index.

    One pass: a minimum by struct, not a window, so that hot texts are reduced
    before the shuffle.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in chunks.columns])
    return chunks.groupBy("content_hash").agg(F.min_by(row, F.struct(order, index)).alias("__lamina_row")).select("__lamina_row.*")


def batch_with_empties(docs: DataFrame, kept: DataFrame, doc: str) -> DataFrame:
    """(doc, chunks): every document with how many chunks are left of it, none too."""
    n = kept.groupBy(F.col("document_id").alias("__lamina_d")).agg(F.count("*").alias("chunks"))
    return docs.select(doc).join(n, F.col(doc).cast("string") == F.col("__lamina_d"), "left").select(doc, F.coalesce("chunks", F.lit(0)).alias("chunks"))


def count_duplicates(chunks: DataFrame) -> DataFrame:
    """One row: total, unique and duplicates."""
    each = chunks.groupBy("content_hash").agg(F.count("*").alias("n"))
    total, unique = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return each.agg(total.alias("total"), unique.alias("unique"), (total - unique).alias("duplicates"))


def chunk_stats(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Statistics of chunk sizes for each group, the document by default.

    total_chunks, total_tokens, avg/min/max/median tokens; the median is the
    upper one. Groups without chunks aren't there. The median is taken from
    counts of each size, so a group of any size costs its distinct sizes.
    """
    by = by or ["document_id"]
    sizes = chunks.groupBy(*by, "token_count").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    below = F.sum("c").over(w.orderBy("token_count").rowsBetween(Window.unboundedPreceding, 0))
    placed = sizes.withColumn("n", F.sum("c").over(w)).withColumn("below", below)
    median = F.min(F.when(F.col("below") > F.floor(F.col("n") / 2), F.col("token_count")))
    total = F.sum(F.col("token_count").cast("long") * F.col("c"))
    return placed.groupBy(*by).agg(
        F.sum("c").alias("total_chunks"),
        total.alias("total_tokens"),
        (total / F.sum("c")).alias("avg_tokens_per_chunk"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        median.alias("median_tokens"),
    )


def language_distribution(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each group's map of language to its number of chunks."""
    by = by or ["document_id"]
    each = chunks.groupBy(*by, "language").agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("language_distribution"))


def get_stats(chunks: DataFrame) -> DataFrame:
    """chunk_stats of each document with its languages and strategy, in one pass over the chunks."""
    sizes = chunks.groupBy("document_id", "language", "token_count").agg(F.count("*").alias("c"), F.min("strategy").alias("strategy"))
    w = Window.partitionBy("document_id")
    below = F.sum("c").over(w.orderBy("token_count", "language").rowsBetween(Window.unboundedPreceding, 0))
    placed = sizes.withColumn("n", F.sum("c").over(w)).withColumn("below", below)
    # Distribution by document serves the groups by document and language too.
    each = placed.groupBy("document_id", "language").agg(
        F.sum("c").alias("c"), F.sum(F.col("token_count").cast("long") * F.col("c")).alias("t"), F.min("token_count").alias("lo"), F.max("token_count").alias("hi"),
        F.min(F.when(F.col("below") > F.floor(F.col("n") / 2), F.col("token_count"))).alias("median"), F.min("strategy").alias("strategy"),
    )
    return each.groupBy("document_id").agg(
        F.sum("c").alias("total_chunks"), F.sum("t").alias("total_tokens"), (F.sum("t") / F.sum("c")).alias("avg_tokens_per_chunk"),
        F.min("lo").alias("min_tokens"), F.max("hi").alias("max_tokens"), F.min("median").alias("median_tokens"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", F.col("c").alias("n"))))).alias("language_distribution"), F.min("strategy").alias("strategy"),
    )
