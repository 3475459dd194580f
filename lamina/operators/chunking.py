"""Documents in, chunks out, with the metadata of each chunk.

One Arrow function takes documents, a few MB at a time, through normalization,
language, sentences and the strategy; per-chunk metadata are built-in
expressions. The plan is narrow: no shuffle, one row of work a document, and one
Python worker a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from lamina.config import ChunkerConfig
from lamina.functions import language, segment, text
from lamina.operators import spec
from lamina.operators.providers import HashEmbedder, Provider, embedder

#: What a custom strategy is: sentences, normalized text and config to chunks.
Strategy = Callable[[list[str], str, ChunkerConfig], list[str]]
_CUSTOM: dict[str, Strategy] = {}

#: Bytes of documents that are chunked at once in a task.
BITE = 2 << 20

_PIECE = pa.struct(
    [
        ("chunk_index", pa.int32()), ("total_chunks", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()),
        ("section_title", pa.string()), ("heading_path", pa.list_(pa.string())), ("hierarchy_level", pa.int32()),
        ("topic_label", pa.string()), ("coherence_score", pa.float64()), ("strategy", pa.string()), ("text", pa.string()),
    ]
)
_ADDED = pa.schema(
    [("total_chars", pa.int32()), ("doc_language", pa.string()), ("total_sentences", pa.int32()), ("total_tokens", pa.int32()), ("pieces", pa.list_(_PIECE))]
)


def register(name: str, strategy: Strategy) -> None:
    """Makes ``strategy`` available to configs as ``name`` on this driver; it is sent to workers with each plan."""
    _CUSTOM[name] = strategy


def _no_section() -> spec.Section:
    return spec.Section()


def chunk_text(
    normalized: str,
    config: ChunkerConfig,
    provider: Provider | None = None,
    ask: Callable[[str, ChunkerConfig], str] | None = None,
    custom: Strategy | None = None,
    counts: bool = True,
) -> dict:
    """All that is known of one normalized document: language, counts, and its chunks in order.

    Without ``counts``, sentences are only told where the strategy needs them.

    A strategy that needs embeddings falls back to recursive if they fail and
    ``enable_fallbacks`` is set; chunks tell which strategy made them.
    """
    lang = segment.language(normalized)
    wanted = counts or custom or config.strategy in ("sentence", "semantic", "agentic")
    sentences = segment.segment(normalized, lang, config) if normalized and wanted else []
    name, found = config.strategy_name, []
    topics: list[str] = []
    scores: list[float] | None = None
    if not normalized.strip():
        pass
    elif custom:
        found = [(c, _no_section()) for c in custom(sentences, normalized, config)]
    elif config.strategy == "structure_aware":
        found = spec.by_structure(normalized, config)
    elif config.strategy == "semantic":
        try:
            chunks = spec.by_meaning(sentences, config, provider.embed)
        except Exception:
            if not config.enable_fallbacks:
                raise
            name, chunks = "recursive", spec.by_separator(normalized, lang, config)
        found = [(c, _no_section()) for c in chunks]
    elif config.strategy == "agentic":
        pairs = spec.by_model(normalized, sentences, config, ask)
        found, topics = [(c, _no_section()) for c, _ in pairs], [t for _, t in pairs]
    else:
        chunks = {
            "recursive": lambda: spec.by_separator(normalized, lang, config),
            "sentence": lambda: spec.by_sentence(sentences, config),
            "fixed": lambda: spec.by_window(normalized, config),
            "hierarchical": lambda: spec.by_hierarchy(normalized, config),
        }[config.strategy]()
        found = [(c, _no_section()) for c in chunks]
    kept = [(i, c, s) for i, (c, s) in enumerate(found) if c.strip()]
    if config.compute_coherence_score and provider:
        scores = [spec.coherence(c, provider.embed) for _, c, _ in kept]
    spots = spec.offsets(normalized, [c for _, c, _ in kept])
    per = 2.5 if lang == "ar" else 3.0
    return {
        "doc_language": lang,
        "total_sentences": len(sentences),
        "total_tokens": sum(max(1, int(len(s) / per)) for s in sentences),
        "pieces": [
            {
                "chunk_index": i, "total_chunks": len(found), "start_char": a, "end_char": b,
                "section_title": s.title, "heading_path": s.path, "hierarchy_level": s.level,
                "topic_label": topics[i] if i < len(topics) else None, "coherence_score": scores[k] if scores else None,
                "strategy": name, "text": c,
            }
            for k, ((i, c, s), (a, b)) in enumerate(zip(kept, spots))
        ],
    }


def bites(batch: pa.RecordBatch, most: int = BITE) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes, so that memory doesn't follow the length of texts times rows."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def pieces(
    docs: DataFrame,
    config: ChunkerConfig,
    provider: Provider | None = None,
    ask: Callable[[str, ChunkerConfig], str] | None = None,
    column: str = "text",
    counts: bool = True,
    read: Callable[[str], str] | None = None,
) -> DataFrame:
    """``docs`` with the document's language, counts and array of chunk structs, without ``column``, which holds texts or what ``read`` makes texts of."""
    custom = _CUSTOM.get(config.strategy)
    if not custom:
        config.validate()
    if config.strategy == "semantic" or config.compute_coherence_score:
        provider = provider or embedder(config)
    if config.strategy == "agentic" and ask is None:
        from lamina.operators.providers import chat

        ask = chat
    kept = [f for f in docs.schema.fields if f.name not in (column, *_ADDED.names)]
    shape = T.StructType([*kept, *from_arrow_schema(_ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bites(whole):
                texts = [text.normalized((read(t) if read else t) or "") if t else "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                rows = [chunk_text(t, config, provider, ask, custom, counts) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:-1],
                        pa.array(map(len, texts), pa.int32()),
                        pa.array([r["doc_language"] for r in rows], pa.string()),
                        pa.array([r["total_sentences"] for r in rows], pa.int32()),
                        pa.array([r["total_tokens"] for r in rows], pa.int32()),
                        pa.array([r["pieces"] for r in rows], pa.list_(_PIECE)),
                    ],
                    names=shape.names,
                )

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], column).mapInArrow(run, shape)


def split_rows(docs: DataFrame, split: Callable[[str], list[str]], document_id: str = "doc_id", column: str = "text") -> DataFrame:
    """(document_id, i, s): what ``split`` makes of each text, numbered; null texts give nothing."""
    shape = T.StructType([docs.schema[document_id], T.StructField("i", T.LongType()), T.StructField("s", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bites(whole):
                found = [[] if t is None else split(t) for t in batch.column(1).to_pylist()]
                own = pa.array([k for k, parts in enumerate(found) for _ in parts], pa.int32())
                places = pa.array([i for parts in found for i in range(len(parts))], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), places, pa.array([s for parts in found for s in parts], pa.string())], names=shape.names)

    return docs.select(document_id, column).mapInArrow(run, shape)


def _flag(name: str, arabic: Column) -> Column:
    return F.when(arabic, F.col("text").rlike(f"(?dm){text.FLAGS_AR[name]}")).otherwise(F.col("text").rlike(f"(?dm){text.FLAGS_EN[name]}"))


def enrich(found: DataFrame, config: ChunkerConfig) -> DataFrame:
    """Metadata of chunk rows that have document_id, source_file, custom, doc_language and the fields of a piece."""
    lang = language.detect_language(F.col("text")) if config.detect_language else F.col("doc_language")
    found = found.withColumn("language", lang)
    arabic = F.col("language") == "ar"
    tokens_as = F.when(F.col("language") == "unknown", F.col("doc_language")).otherwise(F.col("language"))
    over = config.chunk_overlap > 0
    columns = {
        "chunk_id": F.sha2(F.concat_ws("\x1f", "document_id", "strategy", F.col("chunk_index").cast("string"), "text"), 256),
        "document_id": F.col("document_id"),
        "source_file": F.col("source_file"),
        "chunk_index": F.col("chunk_index"),
        "total_chunks": F.col("total_chunks"),
        "start_char": F.col("start_char"),
        "end_char": F.col("end_char"),
        "language": F.col("language"),
        "token_count": text.estimate_tokens(F.col("text"), tokens_as),
        "char_count": F.length("text"),
        "sentence_count": text.count_sentences(F.col("text")),
        "has_overlap_before": (F.col("chunk_index") > 0) & F.lit(over),
        "has_overlap_after": (F.col("chunk_index") < F.col("total_chunks") - 1) & F.lit(over),
        "overlap_tokens": F.lit(max(0, config.chunk_overlap)),
        "topic_label": F.col("topic_label"),
        "coherence_score": F.col("coherence_score"),
        "strategy": F.col("strategy"),
        "contains_header": _flag("has_headers", arabic),
        "contains_table": _flag("has_tables", arabic),
        "contains_code": _flag("has_code", arabic),
        "contains_list": _flag("has_lists", arabic),
        "section_title": F.col("section_title"),
        "heading_path": F.col("heading_path"),
        "hierarchy_level": F.col("hierarchy_level"),
        "script": F.when(arabic, language.detect_script(F.col("text"))).otherwise(F.lit("latin")),
        "text": F.col("text"),
        "content_hash": F.sha2("text", 256),
        "custom": F.col("custom"),
    }
    return found.select(*[c.alias(k) for k, c in columns.items()])


def prepare(docs: DataFrame, document_id: str = "doc_id", column: str = "text", extra: dict[str, str] | None = None) -> DataFrame:
    """document_id, source_file, custom and ``text`` of any table of documents.

    source_file and custom come from columns of these names, if there are any;
    ``extra`` is added to custom. Rows of a null text are left out: they are no
    documents.
    """
    names = docs.columns
    custom = F.col("custom").cast("map<string,string>") if "custom" in names else F.create_map().cast("map<string,string>")
    if extra:
        pairs = [F.lit(str(x)) for kv in extra.items() for x in kv]
        custom = F.map_concat(custom, F.create_map(*pairs))
    return docs.filter(F.col(column).isNotNull()).select(
        F.col(document_id).cast("string").alias("document_id"),
        (F.coalesce(F.col("source_file"), F.lit("")) if "source_file" in names else F.lit("")).alias("source_file"),
        custom.alias("custom"),
        F.col(column).alias("text"),
    )


def chunk(
    docs: DataFrame,
    config: ChunkerConfig = ChunkerConfig(),
    document_id: str = "doc_id",
    column: str = "text",
    provider: Provider | None = None,
    ask: Callable[[str, ChunkerConfig], str] | None = None,
    extra: dict[str, str] | None = None,
    read: Callable[[str], str] | None = None,
) -> DataFrame:
    """Chunks of every document, one a row.

    ``read`` makes a text of what ``column`` holds, in the worker that chunks it.
    Null and blank texts give no chunks. Other columns don't come along; join
    on document_id for them. Equal documents give equal chunks, told apart by
    document_id alone.
    """
    made = pieces(prepare(docs, document_id, column, extra), config, provider, ask, counts=False, read=read)
    return enrich(made.select("document_id", "source_file", "custom", "doc_language", F.inline("pieces")), config)


def document_info(docs: DataFrame, config: ChunkerConfig = ChunkerConfig(), document_id: str = "doc_id", column: str = "text") -> DataFrame:
    """(document_id, source_file, language, total_chars, total_sentences, total_tokens) of every document."""
    made = pieces(prepare(docs, document_id, column), config)
    return made.select(
        "document_id", "source_file", F.col("doc_language").alias("language"),
        "total_chars", "total_sentences", "total_tokens",
    )


def to_dict(chunks: DataFrame) -> DataFrame:
    """Chunks as JSON objects of text, content_hash, embedding and nested metadata, in column ``json``."""
    nested = (
        "chunk_id document_id source_file chunk_index total_chunks start_char end_char language token_count char_count sentence_count "
        "has_overlap_before has_overlap_after topic_label coherence_score strategy section_title heading_path hierarchy_level script custom"
    ).split()
    there = [c for c in nested if c in chunks.columns]
    more = [F.lit(None).cast("boolean").alias("is_dialect"), (F.col("created_at") if "created_at" in chunks.columns else F.lit(None).cast("string")).alias("created_at")]
    vector = F.col("embedding") if "embedding" in chunks.columns else F.lit(None).cast("array<float>")
    return chunks.select(
        F.to_json(
            F.struct("text", "content_hash", F.struct(*there, *more).alias("metadata"), vector.alias("embedding")), {"ignoreNullFields": "false"}
        ).alias("json")
    )


def embed(chunks: DataFrame, provider: Provider = HashEmbedder(), column: str = "text", cache: DataFrame | None = None) -> DataFrame:
    """``chunks`` with an ``embedding`` of each text; a null text has none.

    Distinct texts are embedded once. ``cache`` has key and embedding, by
    cache_key of model and text: texts found there aren't embedded.
    """
    key = "__lamina_key"
    keyed = chunks.drop("embedding").withColumn(key, text.cache_key(F.col(column), provider.model))
    wanted = keyed.filter(F.col(column).isNotNull()).groupBy(key).agg(F.first(column).alias("__lamina_text"))
    known = None
    if cache is not None:
        known = cache.select(F.col("key").alias(key), F.col("embedding").cast("array<float>").alias("embedding"))
        wanted = wanted.join(known, key, "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bites(whole):
                vectors = [np.asarray(v, dtype=np.float32) for v in provider.embed(batch.column(1).to_pylist())]
                ends = np.cumsum([0, *map(len, vectors)], dtype=np.int32)
                flat = pa.array(np.concatenate(vectors) if vectors else [], pa.float32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[key, "embedding"])

    made = wanted.select(key, "__lamina_text").mapInArrow(run, f"{key} string, embedding array<float>")
    table = made if known is None else made.unionByName(known)
    return keyed.join(table, key, "left").drop(key)
