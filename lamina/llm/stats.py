"""Statistics of whole texts, many at once, for quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import tokens

#: Common words of English, French, German and Spanish.
STOP_WORDS = """the of and to in is that it for as was with be by on are this from or an at not have which
le la les de des du et en un une que qui pour dans par sur au est pas avec il
der die das und ist von den mit für auf im ein eine nicht sich des dem zu
el los las y se por con para del al como su más pero lo una""".split()
FIELDS = [
    "n_words", "n_chars", "n_lines", "word_length", "upper", "digits", "symbols", "exclaims", "pipes",
    "stop_words", "adjacent", "repeated", "distinct",
]
_PLAIN = set(b".,;:'\"()-?! \t\n\r\f\x0b|")


def _table(test) -> np.ndarray:
    return np.fromiter((test(i) for i in range(256)), dtype=bool, count=256)


_ASCII_LETTER = _table(lambda i: chr(i).isalpha() and i < 128)
_UPPER = _table(lambda i: 65 <= i <= 90)
_DIGIT = _table(lambda i: 48 <= i <= 57)
_SYMBOL = _table(lambda i: 32 < i < 127 and not chr(i).isalnum() and i not in _PLAIN)
_HEAD = _table(lambda i: not 128 <= i < 192)
_STOP = np.sort(tokens.split([" ".join(STOP_WORDS).encode()])[0])


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _kinds(g: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Share of distinct hashes among each text's; 44 bits of a hash beside the text's index sort as one number."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (g >> np.uint64(20)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    kinds = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=texts)
    return kinds / np.maximum(np.bincount(owner, minlength=texts), 1)


_GROUPS = np.stack([_HEAD, _ASCII_LETTER, _UPPER, _DIGIT, _SYMBOL, tokens._SPACE], axis=1).astype(np.int64)


def measure(texts: list[str | None]) -> np.ndarray:
    """One row of FIELDS for each text; nulls and empty texts give zeros."""
    out = np.zeros((len(texts), len(FIELDS)))
    for first, run in tokens.chunks(texts):
        h, _, _, at, _ = tokens.split(run)
        n = np.diff(at)
        row = out[first : first + len(run)]
        each = np.stack([np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256) for b in run])
        chars, letters, upper, digits, symbols, space = (each @ _GROUPS).T
        words, some = np.maximum(n, 1), np.maximum(chars, 1)
        row[:, 0] = n
        row[:, 1] = chars
        row[:, 2] = each[:, 10] + (chars > 0)
        row[:, 3] = (chars - space) / words
        row[:, 4] = upper / np.maximum(letters, 1)
        row[:, 5] = digits / some
        row[:, 6] = symbols / some
        row[:, 7] = each[:, 33] / words
        row[:, 8] = each[:, 124] / words
        row[:, 9] = _sums(_STOP[np.minimum(np.searchsorted(_STOP, h), len(_STOP) - 1)] == h, at) / words
        same = np.zeros(len(h), dtype=bool)
        same[1:] = h[1:] == h[:-1]
        same[at[:-1][n > 0]] = False
        row[:, 10] = _sums(same, at) / words
        text = np.repeat(np.arange(len(run)), n)
        three = np.arange(len(h)) + 3 <= np.repeat(at[1:], n)
        if len(h) > 2:
            g = tokens.mix(h[:-2] + h[1:-1] * tokens._ODD[1] + h[2:] * tokens._ODD[2])
            row[:, 11] = np.where(n >= 3, 1 - _kinds(g[three[:-2]], text[three], len(run)), 0)
        row[:, 12] = np.where(n > 0, _kinds(h, text, len(run)), 0)
    return out


_SCHEMA = T.StructType([T.StructField(f, T.DoubleType()) for f in FIELDS])


@F.pandas_udf(_SCHEMA)
def _measured(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(measure(text.tolist()), columns=FIELDS)


def text_stats(text: Column) -> Column:
    """Struct of FIELDS: counts, and fractions of characters or of words, over the whole text."""
    return _measured(text)
