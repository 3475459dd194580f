"""Words and word hashes of many texts at once, in numpy.

A word is a maximal run of bytes other than ASCII white space. Its hash is a
polynomial over its bytes modulo 2**64, read from prefix sums, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, which bounds a worker's memory; a longer text is handled alone, whole, in segments of about as many.
CHUNK = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (murmur3 constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those that CHUNK needs are kept, larger tables aren't."""
    size = 1 << max(n, CHUNK).bit_length()
    if size in _POWERS:
        return _POWERS[size]
    up = np.full(size, _BASE, dtype=np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    made = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if size <= 4 * CHUNK:
        _POWERS[size] = made
    return made


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for mapInArrow and the like, that gives freed memory back to the system when a task ends: workers live on."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts (UTF-8, null as empty) of about CHUNK bytes, each with the index of its first text."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if run and size + len(b) > CHUNK:
            yield first, run
            first, size, run = i, 0, []
        run.append(b)
        size += len(b) + 1
    if run:
        yield first, run


def split(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start, end, first word of each text and the total, first byte of each text).

    start and end are byte positions in the joined run.
    """
    lengths = np.fromiter(map(len, run), dtype=np.int64, count=len(run))
    begins = np.zeros(len(run) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=begins[1:])
    raw = np.frombuffer(b"\n".join(run) + b"\n", dtype=np.uint8)
    if len(raw) < 2 * CHUNK - 1:
        h, start, end = _words(raw)
    else:
        parts, at = [], 0
        while at < len(raw):
            stop = _behind(raw, at + CHUNK)
            h, start, end = _words(raw[at:stop])
            parts.append((h, start + at, end + at))
            at = stop
        h, start, end = (np.concatenate(x) for x in zip(*parts))
    return h, start, end, np.searchsorted(start, begins), begins[:-1]


def _behind(raw: np.ndarray, at: int) -> int:
    """Behind the first white space from ``at`` on, so that no word is cut."""
    while at < len(raw):
        found = np.flatnonzero(_SPACE[raw[at : at + 4096]])
        if len(found):
            return at + int(found[0]) + 1
        at += 4096
    return len(raw)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start, end) of words of bytes that begin with a word or white space and end in white space."""
    space = _SPACE[raw]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(space & ~before)
    if raw.size and space[0]:
        end = end[end > 0]
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:], dtype=np.uint64)
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, start, end


_ODD = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1) for i in range(256)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words of one text; a text of fewer words is one run."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * _ODD[i]
    return mix(out + np.uint64(n))
