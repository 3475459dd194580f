"""Embedding and language-model providers, with limiter, retry and circuit breaker.

A provider travels to workers with the plan, so it keeps no live client: what it
loads, it loads once a worker process.
"""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from typing import Any, Protocol

import numpy as np

from lamina.config import ChunkerConfig
from lamina.errors import CircuitOpen, EmbeddingError, FallbackError, wrap

_LOADED: dict[Any, Any] = {}
_LOCK = threading.Lock()


def once(key: Any, make: Callable[[], Any]) -> Any:
    """``make()``, called once for ``key`` in this process."""
    with _LOCK:
        if key not in _LOADED:
            _LOADED[key] = make()
        return _LOADED[key]


def loaded() -> list[Any]:
    with _LOCK:
        return list(_LOADED)


def unload() -> None:
    with _LOCK:
        _LOADED.clear()


class Provider(Protocol):
    model: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Base:
    """A text, its dimension and a batch by way of embed()."""

    model = "none"

    def embed(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def embed_single(self, text: str) -> np.ndarray:
        return self.embed([text])[0]

    def get_dimension(self) -> int:
        return len(self.embed_single(" "))


class _Slots(dict):
    """Slot of each word of up to 32 characters, those of negative words after the ``dimension`` others; emptied when it is full."""

    MOST = 100_000

    def __init__(self, dimension: int):
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        slot = (h >> 1) % self.dimension + (0 if h & 1 else self.dimension)
        if len(word) <= 32:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = slot
        return slot


_slots = lru_cache(maxsize=4)(_Slots)


@dataclass(frozen=True)
class HashEmbedder(Base):
    """Signed hashes of lower-case words, scaled to unit length: the same everywhere, without a model."""

    dimension: int = 256
    model: str = "hash"

    def embed(self, texts: list[str]) -> np.ndarray:
        n, slots = self.dimension, _slots(self.dimension)
        out = np.zeros((len(texts), n))
        for at in range(0, len(texts), 500):
            words = [t.lower().split() for t in texts[at : at + 500]]
            rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
            places = np.fromiter(map(slots.__getitem__, chain.from_iterable(words)), np.int64, len(rows))
            counts = np.bincount(rows * (2 * n) + places, minlength=len(words) * 2 * n).reshape(-1, 2, n)
            out[at : at + 500] = counts[:, 0] - counts[:, 1]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class SentenceTransformerProvider(Base):
    """Local sentence models, if their package is installed where the workers run."""

    model: str = "BAAI/bge-m3"
    device: str | None = None
    batch_size: int = 64
    normalize: bool = True

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, 0), dtype=np.float32)
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise EmbeddingError("sentence-transformers isn't installed") from e
        model = once(("sentence", self.model, self.device), lambda: SentenceTransformer(self.model, device=self.device))
        return np.asarray(model.encode(texts, batch_size=self.batch_size, normalize_embeddings=self.normalize, show_progress_bar=False))


class TokenBucket:
    """At most ``per_minute`` calls a minute; acquire() waits."""

    def __init__(self, per_minute: int = 500, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.room, self.clock, self.sleep = per_minute / 60, float(per_minute), clock, sleep
        self.held, self.last, self.lock = float(per_minute), clock(), threading.Lock()

    def acquire(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                self.held = min(self.room, self.held + (now - self.last) * self.rate)
                self.last = now
                if self.held >= 1:
                    self.held -= 1
                    return
                wait = (1 - self.held) / self.rate
            self.sleep(wait)


def with_retry(call: Callable[[], Any], retries: int = 3, first: float = 1.0, factor: float = 2.0, on: tuple = (Exception,), sleep=time.sleep) -> Any:
    """``call()``, again after first * factor**attempt seconds while it fails."""
    for attempt in range(retries + 1):
        try:
            return call()
        except on:
            if attempt == retries:
                raise
            sleep(first * factor**attempt)
    raise AssertionError


def with_fallback(primary: Callable[[], Any], fallback: Callable[[], Any] | None, enabled: bool = True, name: str = "") -> Any:
    """``primary()``, or ``fallback()`` if it fails; if both fail, an error that tells of both."""
    try:
        return primary()
    except Exception as e:
        if not enabled or fallback is None:
            raise wrap(e, name) from e
        try:
            return fallback()
        except Exception as second:
            raise FallbackError(f"{name}: {e}; then its fallback: {second}") from second


class CircuitBreaker:
    """After ``failures`` failures in a row calls are refused for ``timeout`` seconds; then one is let through to try."""

    def __init__(self, failures: int = 5, timeout: float = 60.0, expected: type[Exception] = Exception, clock=time.monotonic):
        self.limit, self.timeout, self.expected, self.clock = failures, timeout, expected, clock
        self.lock = threading.RLock()
        self.reset()

    def reset(self) -> None:
        with self.lock:
            self.failures, self.opened = 0, None

    @property
    def state(self) -> str:
        with self.lock:
            if self.opened is None:
                return "closed"
            return "half_open" if self.clock() - self.opened >= self.timeout else "open"

    def call(self, f: Callable, *args, **kwargs) -> Any:
        if self.state == "open":
            raise CircuitOpen("calls are refused after repeated failures")
        try:
            out = f(*args, **kwargs)
        except self.expected:
            with self.lock:
                half = self.opened is not None
                self.failures += 1
                if half or self.failures >= self.limit:
                    self.opened = self.clock()
            raise
        self.reset()
        return out


@dataclass(frozen=True)
class OpenAIEmbeddingProvider(Base):
    """Embeddings by an OpenAI-compatible service. ``client`` makes one, for tests or other endpoints.

    The limit is a worker's own: the cluster's is that times its workers.
    """

    model: str = "text-embedding-3-small"
    api_key: str | None = None
    requests_per_minute: int = 500
    per_call: int = 2047
    max_retries: int = 3
    client: Callable[[], Any] | None = None
    backoff: float = 2.0
    dimensions: dict = field(default_factory=lambda: {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}, hash=False)

    def _client(self):
        if self.client:
            return self.client()
        try:
            from openai import OpenAI
        except ImportError as e:
            raise EmbeddingError("openai isn't installed") from e
        key = self.api_key or ChunkerConfig().secret()
        if not key:
            raise EmbeddingError("no API key is set")
        return OpenAI(api_key=key)

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.get_dimension()), dtype=np.float32)
        client = once(("openai", self.model, self.api_key, self.client), self._client)
        bucket = once(("bucket", self.requests_per_minute), lambda: TokenBucket(self.requests_per_minute))
        out = []
        for i in range(0, len(texts), self.per_call):
            part = [t if t.strip() else " " for t in texts[i : i + self.per_call]]
            bucket.acquire()
            reply = with_retry(lambda: client.embeddings.create(model=self.model, input=part), self.max_retries, factor=self.backoff)
            out += [x.embedding for x in sorted(reply.data, key=lambda x: x.index)]
        return np.asarray(out, dtype=np.float32)

    def get_dimension(self) -> int:
        return self.dimensions.get(self.model, 1536)


def _retries(config: ChunkerConfig) -> int:
    return config.max_retries if config.retry_on_network_error else 0


def embedder(config: ChunkerConfig) -> Provider:
    """The provider a config names; ``hash`` is the one that needs no model."""
    kind = getattr(config.embedding_provider, "value", config.embedding_provider)
    if kind == "sentence_transformer":
        return SentenceTransformerProvider(config.embedding_model)
    if kind == "openai":
        return OpenAIEmbeddingProvider(config.embedding_model, config.openai_api_key, max_retries=_retries(config), backoff=config.retry_backoff_factor)
    if kind == "hash":
        return HashEmbedder()
    raise EmbeddingError(f"pass a provider of your own for embedding_provider {kind!r}")


_SYSTEM = (
    "You divide documents for retrieval. Give back a JSON array and nothing else; each element is an object with \"text\", a passage "
    "copied exactly from the document, and \"topic\", a few words in the passage's language. Passages follow the document's order, cover one "
    "topic each, end with whole sentences (in Arabic also at ؟ and ؛), keep headings, lists, tables and code together, and can be understood alone. "
    "Aim at {size} tokens, about {chars} characters; not under {least} and not over {most} tokens."
)


def chat(text: str, config: ChunkerConfig, client: Any = None, sleep=time.sleep) -> str:
    """A language model's division of ``text``, as it replies.

    Calls are retried as ``config`` says and keep a worker's limit; after
    repeated failures its circuit breaker refuses them for a while.
    """

    def make():
        from openai import OpenAI

        return OpenAI(api_key=config.secret())

    name = config.secret() if client is None else id(client)
    client = client or once(("chat", name), make)
    breaker, bucket = once(("breaker", name), CircuitBreaker), once(("bucket", 500), TokenBucket)
    system = _SYSTEM.format(size=config.chunk_size, chars=config.chunk_size * 4, least=config.min_chunk_size, most=config.max_chunk_size)

    def call():
        bucket.acquire()
        return client.chat.completions.create(
            model=config.llm_model,
            messages=[{"role": "system", "content": system}, {"role": "user", "content": f"The document:\n\n{text}"}],
            temperature=0.0,
            max_tokens=4096,
        )

    reply = breaker.call(with_retry, call, _retries(config), factor=config.retry_backoff_factor, sleep=sleep)
    return reply.choices[0].message.content
