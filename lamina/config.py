"""Settings of a chunking run, checked before any plan is built."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

STRATEGIES = ("structure_aware", "semantic", "recursive", "sentence", "fixed", "hierarchical", "agentic")
THRESHOLDS = ("percentile", "standard_deviation", "interquartile", "gradient")
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
#: Accepted for compatibility; Spark or the plan decides these, so they change nothing.
INERT = {
    "similarity_metric": "cosine",
    "respect_sentence_boundaries": True,
    "preserve_structure": True,
    "arabic_morphological_decomposition": True,
    "headings_are_hard_boundaries": True,
    "overlap_across_headings": False,
    "metadata_enrichment": True,
    "batch_embedding_calls": True,
    "enable_parallel_processing": False,
    "num_workers": None,
    "progress_callback": None,
    "lazy_load_embeddings": True,
    "lazy_load_nlp_tools": True,
    # Embeddings are kept by embed(cache=) and sinks.save_embeddings; telling a language costs less than finding it in a cache.
    "enable_embedding_cache": True,
    "embedding_cache_size": 10000,
    "enable_language_cache": True,
    "language_cache_size": 5000,
    "persist_cache_to_disk": False,
    "cache_dir": None,
    "verbose": False,
    "preload_components": [],
}


@dataclass(frozen=True)
class ChunkerConfig:
    """All sizes are in estimated tokens.

    ``compat`` brings back three behaviours of the original that lose data: a
    line after a blank one is dropped by the structure parser, oversize lists
    keep only their items' first lines, and fixed windows may fail to advance
    (here such a window ends with an error instead of never).
    """

    strategy: str = "structure_aware"
    chunk_size: int = 220
    chunk_overlap: int = 0
    min_chunk_size: int = 80
    max_chunk_size: int = 320
    threshold_type: str = "percentile"
    threshold_amount: float = 90.0
    embedding_provider: str = "sentence_transformer"
    embedding_model: str = "BAAI/bge-m3"
    similarity_metric: str = "cosine"
    respect_sentence_boundaries: bool = True
    detect_language: bool = True
    preserve_structure: bool = True
    arabic_normalize_alef: bool = True
    arabic_normalize_yeh: bool = False
    arabic_normalize_teh_marbuta: bool = False
    arabic_remove_tashkeel: bool = True
    arabic_remove_tatweel: bool = True
    arabic_normalize_punctuation: bool = True
    arabic_morphological_decomposition: bool = True
    headings_are_hard_boundaries: bool = True
    overlap_across_headings: bool = False
    recursive_separators_en: tuple[str, ...] = ("\n\n\n", "\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
    recursive_separators_ar: tuple[str, ...] = ("\n\n\n", "\n\n", "\n", "。", ".‏", ". ", "؟ ", "! ", "، ", "؛ ", " ")
    metadata_enrichment: bool = True
    compute_coherence_score: bool = False
    openai_api_key: str | None = None
    llm_model: str = "gpt-4o-mini"
    verbose: bool = False
    enable_embedding_cache: bool = True
    embedding_cache_size: int = 10000
    enable_language_cache: bool = True
    language_cache_size: int = 5000
    persist_cache_to_disk: bool = False
    cache_dir: str | None = None
    batch_embedding_calls: bool = True
    batch_size: int = 32
    enable_parallel_processing: bool = False
    num_workers: int | None = None
    enable_fallbacks: bool = True
    retry_on_network_error: bool = True
    max_retries: int = 3
    retry_backoff_factor: float = 2.0
    enable_metrics: bool = True
    enable_structured_logging: bool = True
    log_level: str = "INFO"
    progress_callback: Callable | None = None
    preload_components: list[str] = field(default_factory=list)
    lazy_load_embeddings: bool = True
    lazy_load_nlp_tools: bool = True
    compat: bool = False

    def __post_init__(self):
        object.__setattr__(self, "strategy", getattr(self.strategy, "value", self.strategy))
        object.__setattr__(self, "threshold_type", getattr(self.threshold_type, "value", self.threshold_type))

    def validate(self) -> ChunkerConfig:
        """Raises ValueError for values out of range or at odds; warns of settings that have no effect."""
        problems = [
            (self.strategy not in STRATEGIES, f"strategy must be one of {STRATEGIES}, got {self.strategy}"),
            (self.threshold_type not in THRESHOLDS, f"threshold_type must be one of {THRESHOLDS}, got {self.threshold_type}"),
            (self.chunk_size < self.min_chunk_size, f"chunk_size ({self.chunk_size}) must be >= min_chunk_size ({self.min_chunk_size})"),
            (self.chunk_overlap >= self.chunk_size, f"chunk_overlap ({self.chunk_overlap}) must be < chunk_size ({self.chunk_size})"),
            (
                self.threshold_type == "percentile" and not 0 < self.threshold_amount <= 100,
                f"a percentile must be in (0, 100], got {self.threshold_amount}",
            ),
            (self.strategy == "agentic" and not self.openai_api_key, "the agentic strategy needs openai_api_key"),
            (self.embedding_cache_size < 0, f"embedding_cache_size must be >= 0, got {self.embedding_cache_size}"),
            (self.language_cache_size < 0, f"language_cache_size must be >= 0, got {self.language_cache_size}"),
            (self.persist_cache_to_disk and not self.cache_dir, "persist_cache_to_disk needs cache_dir"),
            (self.batch_size < 1, f"batch_size must be >= 1, got {self.batch_size}"),
            (self.num_workers is not None and self.num_workers < 1, f"num_workers must be >= 1 or None, got {self.num_workers}"),
            (self.max_retries < 0, f"max_retries must be >= 0, got {self.max_retries}"),
            (self.retry_backoff_factor <= 0, f"retry_backoff_factor must be > 0, got {self.retry_backoff_factor}"),
            (self.log_level not in LEVELS, f"log_level must be one of {LEVELS}, got {self.log_level}"),
        ]
        for wrong, message in problems:
            if wrong:
                raise ValueError(message)
        changed = [k for k, v in INERT.items() if getattr(self, k) != v]
        if changed:
            warnings.warn(f"no effect: {', '.join(changed)}", stacklevel=2)
        return self

    def with_(self, **changes) -> ChunkerConfig:
        return replace(self, **changes)

    @property
    def strategy_name(self) -> str:
        """As it stands in chunk metadata, where fixed is called fixed_size."""
        return "fixed_size" if self.strategy == "fixed" else self.strategy

    def secret(self) -> str | None:
        """The key of the language model's service: as set, else from the environment."""
        return self.openai_api_key or os.environ.get("OPENAI_API_KEY")

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]
