"""Writers of chunks: vector stores, embedding cache, JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lamina.functions.text import cache_key
from lamina.operators import vectors

#: Metadata that each kind of store gets, and rows it takes at once.
STORES = {
    "chroma": ("document_id source_file chunk_index language token_count strategy section_title hierarchy_level contains_table contains_code".split(), 1000),
    "pinecone": ("document_id source_file chunk_index language token_count section_title text".split(), 100),
    "qdrant": ("chunk_id document_id source_file chunk_index language token_count strategy section_title heading_path text".split(), 64),
}


def records(chunks: DataFrame, store: str) -> DataFrame:
    """(id, document, metadata, vector) as a store of that kind takes them.

    Qdrant takes numbers and UUIDs only: there the id is the first 128 bits of
    chunk_id as a UUID, and the payload has chunk_id itself.
    """
    name = F.col("chunk_id")
    if store == "qdrant":
        name = F.concat_ws("-", *[F.substring("chunk_id", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    fields = [c for c in STORES[store][0] if c in chunks.columns]
    plain = [F.col(c) if c != "heading_path" or store == "qdrant" else F.array_join(c, " > ").alias(c) for c in fields]
    vector = F.col("embedding").cast("array<float>") if "embedding" in chunks.columns else F.lit(None).cast("array<float>")
    return chunks.select(name.alias("id"), F.col("text").alias("document"), F.struct(*plain).alias("metadata"), vector.alias("vector"))


def _send(rows: Iterator[Row], client: Any, store: str, size: int, name: str) -> None:
    held: list[Row] = []

    def flush() -> None:
        ids, meta = [r["id"] for r in held], [r["metadata"].asDict(True) for r in held]
        if store == "chroma":
            # A call has a vector of every row or of none.
            for bare in (False, True):
                own = [(r["id"], r["document"], m, r["vector"]) for r, m in zip(held, meta) if (r["vector"] is None) == bare]
                if own:
                    i, d, m, v = map(list, zip(*own))
                    client.upsert(ids=i, documents=d, metadatas=m, **({} if bare else {"embeddings": [list(x) for x in v]}))
        elif store == "pinecone":
            client.upsert(vectors=[{"id": i, "values": list(r["vector"]), "metadata": m} for i, r, m in zip(ids, held, meta)], namespace=name)
        else:
            client.upsert(collection_name=name, points=[{"id": i, "vector": list(r["vector"]), "payload": m} for i, r, m in zip(ids, held, meta)])
        held.clear()

    for r in rows:
        held.append(r)
        if len(held) == size:
            flush()
    if held:
        flush()


def write(chunks: DataFrame, store: str, client: Callable[[], Any], name: str = "", batch_size: int | None = None) -> None:
    """Upserts chunks into a store; ``client`` makes a collection or client where a partition is.

    chunk_id doesn't change between attempts, so a repeated task writes the same
    rows again. Stores but chroma need an embedding of every chunk.
    """
    found = records(chunks, store)
    if store != "chroma":
        checked = F.when(F.col("vector").isNull(), F.raise_error(F.concat(F.lit("no embedding of chunk "), "id"))).otherwise(F.col("vector"))
        if "embedding" not in chunks.columns:
            raise ValueError(f"{store} needs a column embedding")
        found = found.withColumn("vector", checked)
    size = batch_size or STORES[store][1]
    found.foreachPartition(lambda rows: _send(rows, client(), store, size, name))


def search(chunks: DataFrame, query: list[float], k: int = 5, where: Column | str | None = None) -> DataFrame:
    """(id, document, score, distance) of the nearest chunks, for tables that serve as their own store."""
    found = vectors.search(chunks, query, k, where, key="chunk_id")
    return found.select(F.col("chunk_id").alias("id"), F.col("text").alias("document"), "score", "distance")


def save_embeddings(embedded: DataFrame, model: str, path: str) -> None:
    """Adds (key, model, embedding) of each distinct text to the cache at ``path``, less those that are there."""
    spark = embedded.sparkSession
    new = embedded.filter("embedding is not null").select(cache_key(F.col("text"), model).alias("key"), F.lit(model).alias("model"), F.col("embedding").cast("array<float>"))
    new = new.dropDuplicates(["key"])
    old = load_embeddings(spark, path)
    if old is not None:
        new = new.join(old, "key", "left_anti")
    new.write.mode("append").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache at ``path``, None if there is none. Pickled caches aren't read."""
    if path.endswith(".pkl"):
        raise OSError("pickled caches aren't read; write a new one")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema("key string, model string, embedding array<float>").parquet(path)


def cache_stats(wanted: DataFrame, cache: DataFrame | None, model: str) -> DataFrame:
    """One row: embedding_hits, embedding_misses, embedding_hit_rate, embedding_cache_size for the texts of ``wanted``."""
    keys = wanted.filter("text is not null").select(cache_key(F.col("text"), model).alias("key"))
    if cache is None:
        cache = wanted.sparkSession.createDataFrame([], "key string")
    each = keys.join(cache.select("key", F.lit(1).alias("hit")).dropDuplicates(["key"]), "key", "left")
    n, hits = F.count("*"), F.count("hit")
    stats = each.agg(hits.alias("embedding_hits"), (n - hits).alias("embedding_misses"), F.coalesce(F.try_divide(hits, n), F.lit(0.0)).alias("embedding_hit_rate"))
    return stats.crossJoin(cache.agg(F.count("*").alias("embedding_cache_size")))
