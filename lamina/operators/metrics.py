"""Metrics of runs, their Prometheus text, and structured log events."""

from __future__ import annotations

import json
import logging
import threading
import time
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Columns of a table of runs, one row a document.
RUNS = "document_id string, language string, strategy string, duration_ms double, chunk_count int, token_count int"
_COUNTERS = [
    ("documents_processed", "documents_processed_total", "counter", "Documents processed"),
    ("total_chunks_created", "chunks_created_total", "counter", "Chunks created"),
    ("total_tokens_processed", "tokens_processed_total", "counter", "Tokens processed"),
    ("total_processing_time_ms", "processing_time_ms", "summary", "Milliseconds spent"),
    ("embedding_cache_hits", "embedding_cache_hits_total", "counter", "Embeddings found in the cache"),
    ("embedding_cache_misses", "embedding_cache_misses_total", "counter", "Embeddings not in the cache"),
    ("embedding_cache_hit_rate", "embedding_cache_hit_rate", "gauge", "Share of embeddings found"),
    ("total_errors", "errors_total", "counter", "Errors"),
    ("fallbacks_triggered", "fallbacks_triggered_total", "counter", "Fallbacks taken"),
]


def runs_of(chunks: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """A row a document as RUNS has them; ``durations`` has document_id and duration_ms."""
    each = chunks.groupBy("document_id").agg(
        F.min_by("language", "chunk_index").alias("language"), F.min("strategy").alias("strategy"),
        F.count("*").cast("int").alias("chunk_count"), F.sum("token_count").cast("int").alias("token_count"),
    )
    if durations is None:
        return each.withColumn("duration_ms", F.lit(None).cast("double"))
    return each.join(durations.select("document_id", F.col("duration_ms").cast("double")), "document_id", "left")


def summary(runs: DataFrame) -> DataFrame:
    """One row over all runs, with the times' sum, mean, least and largest."""
    t = F.col("duration_ms")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return runs.agg(
        F.count("*").alias("documents_processed"),
        F.coalesce(F.sum(F.col("chunk_count").cast("long")), F.lit(0)).alias("total_chunks_created"),
        F.coalesce(F.sum(F.col("token_count").cast("long")), F.lit(0)).alias("total_tokens_processed"),
        zero(F.sum(t)).alias("total_processing_time_ms"),
        zero(F.avg(t)).alias("avg_processing_time_ms"),
        zero(F.min(t)).alias("min_processing_time_ms"),
        zero(F.max(t)).alias("max_processing_time_ms"),
    )


def strategy_summary(runs: DataFrame) -> DataFrame:
    """(strategy, usage, avg_ms)."""
    return runs.groupBy("strategy").agg(F.count("*").alias("usage"), F.avg("duration_ms").alias("avg_ms"))


def language_summary(runs: DataFrame) -> DataFrame:
    """(language, documents)."""
    return runs.groupBy("language").agg(F.count("*").alias("documents"))


def observed(chunks: DataFrame, name: str = "chunks") -> tuple[DataFrame, Observation]:
    """``chunks``, and counts of them that are there once an action has run, without a job of their own."""
    o = Observation(name)
    return chunks.observe(o, F.count("*").alias("total_chunks_created"), F.sum("token_count").alias("total_tokens_processed")), o


class MetricsCollector:
    """Counters on the driver, fed by what jobs report. Disabled, it keeps nothing."""

    def __init__(self, enabled: bool = True):
        self.enabled, self._lock = enabled, threading.Lock()
        self.reset()

    def reset(self) -> None:
        with self._lock:
            self.n = dict.fromkeys(
                "documents chunks tokens embedding_calls embedding_hits embedding_misses detections language_hits language_misses errors recoverable unrecoverable fallbacks".split(), 0
            )
            #: Number, sum, least and largest of the times; number and sum by strategy. They don't grow with the documents.
            self.times = (0, 0.0, 0.0, 0.0)
            self.strategies: dict[str, tuple[int, float]] = {}
            self.languages: dict[str, int] = {}

    def _add(self, **more: int) -> None:
        for k, v in more.items():
            self.n[k] += v

    def _time(self, n: int, total: float, least: float, most: float) -> None:
        if n:
            m, t, lo, hi = self.times
            self.times = (m + n, t + total, min(lo, least) if m else least, max(hi, most) if m else most)

    def _strategy(self, name: str, n: int, total: float) -> None:
        m, t = self.strategies.get(name, (0, 0.0))
        self.strategies[name] = (m + n, t + total)

    def record_document_processed(self, doc_id: str, language: str, strategy: str, duration_ms: float, chunk_count: int, token_count: int) -> None:
        if not self.enabled:
            return
        with self._lock:
            self._add(documents=1, chunks=chunk_count, tokens=token_count)
            self._time(1, duration_ms, duration_ms, duration_ms)
            self._strategy(getattr(strategy, "value", strategy), 1, duration_ms)
            language = getattr(language, "value", language)
            self.languages[language] = self.languages.get(language, 0) + 1

    def record_embedding_call(self, model: str, batch_size: int, duration_ms: float, cache_hit: bool = False) -> None:
        if self.enabled:
            with self._lock:
                self._add(embedding_calls=1, **({"embedding_hits": batch_size} if cache_hit else {"embedding_misses": batch_size}))

    def record_cache_access(self, kind: str, hit: bool) -> None:
        """Of languages; embeddings are counted with their calls."""
        if self.enabled and kind == "language":
            with self._lock:
                self._add(detections=1, **({"language_hits": 1} if hit else {"language_misses": 1}))

    def record_error(self, error_type: str, recoverable: bool) -> None:
        if self.enabled:
            with self._lock:
                self._add(errors=1, **({"recoverable": 1, "fallbacks": 1} if recoverable else {"unrecoverable": 1}))

    def record_runs(self, runs: DataFrame) -> None:
        """Takes in the totals of a table of runs."""
        if not self.enabled:
            return
        one = summary(runs).first()
        by_strategy, by_language = strategy_summary(runs).collect(), language_summary(runs).collect()
        with self._lock:
            self._add(documents=one["documents_processed"], chunks=one["total_chunks_created"], tokens=one["total_tokens_processed"])
            self._time(one["documents_processed"], one["total_processing_time_ms"], one["min_processing_time_ms"], one["max_processing_time_ms"])
            for r in by_strategy:
                self._strategy(r["strategy"], r["usage"], (r["avg_ms"] or 0.0) * r["usage"])
            for r in by_language:
                self.languages[r["language"]] = self.languages.get(r["language"], 0) + r["documents"]

    def get_summary(self) -> dict[str, Any]:
        with self._lock:
            n, (count, total, least, most) = self.n, self.times
            asked = n["embedding_hits"] + n["embedding_misses"]
            return {
                "documents_processed": n["documents"], "total_chunks_created": n["chunks"], "total_tokens_processed": n["tokens"],
                "total_processing_time_ms": total, "avg_processing_time_ms": total / count if count else 0.0,
                "min_processing_time_ms": least, "max_processing_time_ms": most,
                "embedding_calls": n["embedding_calls"], "embedding_cache_hits": n["embedding_hits"], "embedding_cache_misses": n["embedding_misses"],
                "embedding_cache_hit_rate": n["embedding_hits"] / asked if asked else 0.0,
                "language_detections": n["detections"], "language_cache_hits": n["language_hits"], "language_cache_misses": n["language_misses"],
                "total_errors": n["errors"], "recoverable_errors": n["recoverable"], "unrecoverable_errors": n["unrecoverable"], "fallbacks_triggered": n["fallbacks"],
                "strategy_usage": {k: m for k, (m, _) in self.strategies.items()},
                "strategy_timing": {k: t / m for k, (m, t) in self.strategies.items() if m},
                "language_distribution": dict(self.languages),
            }

    def export_prometheus(self, prefix: str = "lamina") -> str:
        """All of it in Prometheus' text format; nothing if disabled."""
        return prometheus(self.get_summary(), prefix) if self.enabled else ""


def prometheus(values: dict[str, Any], prefix: str = "lamina") -> str:
    out = []
    for key, name, kind, told in _COUNTERS:
        full = f"{prefix}_{name}"
        out += [f"# HELP {full} {told}", f"# TYPE {full} {kind}"]
        v = values.get(key, 0)
        out += [f"{full}_sum {v}", f"{full}_count {values.get('documents_processed', 0)}"] if kind == "summary" else [f"{full} {v}"]
    for key, label, told in (("strategy_usage", "strategy", "Documents by strategy"), ("language_distribution", "language", "Documents by language")):
        full = f"{prefix}_{key}_total"
        out += [f"# HELP {full} {told}", f"# TYPE {full} counter"]
        out += [f'{full}{{{label}="{k}"}} {v}' for k, v in values.get(key, {}).items()]
    return "\n".join(out) + "\n"


class StructuredLogger:
    """Events as lines of JSON, or as ``[event] k=v`` text."""

    def __init__(self, enabled: bool = True, level: str = "INFO", name: str = "lamina"):
        self.enabled, self.log = enabled, logging.getLogger(name)
        self.log.setLevel(level)

    def event(self, event: str, level: int = logging.INFO, **fields: Any) -> str:
        fields = {k: getattr(v, "value", v) for k, v in fields.items()}
        if self.enabled:
            line = json.dumps({"timestamp": datetime.now(UTC).isoformat(), "event": event, **fields}, ensure_ascii=False, default=str)
        else:
            line = f"[{event}] " + " ".join(f"{k}={v}" for k, v in fields.items())
        self.log.log(level, line)
        return line

    def chunking_start(self, doc_id, text_length, strategy):
        return self.event("chunking_start", doc_id=doc_id, text_length=text_length, strategy=strategy)

    def chunking_complete(self, doc_id, duration_ms, chunk_count, strategy):
        return self.event("chunking_complete", doc_id=doc_id, duration_ms=duration_ms, chunk_count=chunk_count, strategy=strategy)

    def language_detected(self, doc_id, language, confidence=1.0):
        return self.event("language_detected", doc_id=doc_id, language=language, confidence=confidence)

    def cache_hit(self, kind, key):
        return self.event("cache_hit", logging.DEBUG, cache_type=kind, key=key)

    def fallback_activated(self, primary, fallback, reason):
        return self.event("fallback_activated", logging.WARNING, primary=primary, fallback=fallback, reason=reason)

    def error_occurred(self, error, context=None):
        return self.event("error_occurred", logging.ERROR, error_type=type(error).__name__, message=str(error), context=context or {})

    def operation_timing(self, operation, duration_ms):
        return self.event("operation_timing", logging.DEBUG, operation=operation, duration_ms=duration_ms)


def log_events(runs: DataFrame) -> DataFrame:
    """A chunking_complete event for each run, as a line of JSON."""
    return runs.select(
        F.to_json(F.struct(F.lit("chunking_complete").alias("event"), F.col("document_id").alias("doc_id"), "duration_ms", "chunk_count", "strategy")).alias("json")
    )


class timer:
    """Milliseconds of a block, in ``ms``."""

    def __enter__(self):
        self._at = time.perf_counter()
        return self

    def __exit__(self, *_):
        self.ms = (time.perf_counter() - self._at) * 1000
