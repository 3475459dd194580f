"""Errors that users may tell apart."""

from __future__ import annotations


class ChunkerException(Exception):
    """Any error of this library. ``recoverable``: another attempt or way may succeed."""

    recoverable = False

    def __init__(self, message: str = "", *, recoverable: bool | None = None, context: dict | None = None):
        super().__init__(message)
        if recoverable is not None:
            self.recoverable = recoverable
        self.context = context or {}


class ConfigurationError(ChunkerException):
    """Settings are out of range or at odds."""


class InputValidationError(ChunkerException):
    """What was passed is no document."""


class LanguageDetectionError(ChunkerException):
    recoverable = True


class SegmentationError(ChunkerException):
    recoverable = True


class EmbeddingError(ChunkerException):
    recoverable = True


class StrategyError(ChunkerException):
    recoverable = True


class CacheError(ChunkerException):
    recoverable = True


class NetworkError(ChunkerException):
    recoverable = True


class TimeoutExceeded(NetworkError):
    pass


class RateLimited(NetworkError):
    pass


class ReaderError(ChunkerException):
    """A file can't be read as what it is said to be."""


class DependencyError(ChunkerException):
    """An optional package is missing."""


class FallbackError(ChunkerException):
    """The first way failed and so did the second."""


class CircuitOpen(ChunkerException):
    recoverable = True


_KINDS = [
    (ConnectionError, NetworkError),
    (TimeoutError, TimeoutExceeded),
    (ImportError, DependencyError),
    (ValueError, InputValidationError),
    (OSError, CacheError),
]


def wrap(error: Exception, where: str = "") -> ChunkerException:
    """``error`` as one of this library's, unless it is one."""
    if isinstance(error, ChunkerException):
        return error
    kind = next((to for of, to in _KINDS if isinstance(error, of)), ChunkerException)
    return kind(f"{where}: {error}" if where else str(error))
