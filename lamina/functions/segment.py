"""Sentences and paragraphs: plain functions for Arrow batches, and the same as columns where Catalyst can say it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.config import ChunkerConfig
from lamina.functions.text import PUNCTUATION, TASHKEEL, TATWEEL, WS, YEH, strip
from lamina.functions.text import ALEF as _ALEF
from lamina.functions.text import TEH as _TEH

#: Stems of abbreviations whose period ends no sentence, wherever they end a run of letters.
STEMS = (
    "mr mrs ms dr prof sr jr st vs etc inc ltd co corp jan feb mar apr jun jul aug sep oct nov dec fig eq ref vol no pp ed"
).split()
#: And those of two letters and two periods.
DOUBLE = ("e.g", "i.e", "a.m", "p.m", "u.s", "u.k")
ABBREVIATIONS = sorted([f"{x}." for x in (*STEMS, *DOUBLE)])

_STEMS = tuple(STEMS)
_LONGEST = max(map(len, STEMS))
_FIRST = {d[0]: set() for d in DOUBLE}
for _d in DOUBLE:
    _FIRST[_d[0]].add(_d[2])
# They begin with the mark that ends a sentence and stays with it: a set to begin with is sought faster than a place behind one.
_ENDS = re.compile(r"""[.!?]["')\]]*\s+(?=[A-Z"'(\[])""")
_FAST = re.compile(r"[.!?؟]\s+")
_WIDER = re.compile(r"[.!?؟؛]\s+")
_ARABIC = re.compile(r"[.!؟؛]\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_LATIN = re.compile(r"[a-zA-Z]")
_SCRIPT = re.compile("[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")
_LATINS, _SCRIPTS = re.compile(f"{_LATIN.pattern}+"), re.compile(f"{_SCRIPT.pattern}+")
_MARKS = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), TASHKEEL))


def _parts(ends: re.Pattern, text: str) -> list[str]:
    """``text`` cut after the mark that each match of ``ends`` begins with; the rest of the match is left out."""
    out, after = [], 0
    for m in ends.finditer(text):
        a, b = m.span()
        out.append(text[after : a + 1])
        after = b
    return [*out, text[after:]]


def clean(parts: list[str]) -> list[str]:
    return [s for p in parts if (s := p.strip())]


def fast(text: str) -> list[str]:
    """Cut at white space after a mark that ends sentences."""
    return clean(_parts(_FAST, text))


def wider(text: str) -> list[str]:
    """As fast, and after an Arabic semicolon."""
    return _parts(_WIDER, text)


def paragraphs(text: str) -> list[str]:
    return clean(_PARAGRAPH.split(text))


def _shield(text: str) -> str:
    """Abbreviations in lower case, their periods as NUL. Pieces between periods decide it, without a pattern an abbreviation."""
    pieces = text.split(".")
    out = []
    after = len(pieces) - 1
    done = False  # the period before this piece is the middle one of a double
    for i, piece in enumerate(pieces):
        if i == after:
            out.append(piece)
            break
        low = piece[-_LONGEST:].casefold()
        if done:
            out += [low, "\0"]
            done = False
            continue
        follows = _FIRST.get(low[-1:])
        if follows and i + 1 < after and pieces[i + 1].casefold() in follows:
            out += [piece[:-1], low[-1:], "\0"]
            done = True
            continue
        if low.endswith(_STEMS):
            stem = next(s for s in STEMS if low.endswith(s))
            out += [piece[: -len(stem)], stem, "\0"]
        else:
            out += [piece, "."]
    return "".join(out)


def english(text: str) -> list[str]:
    """Sentences by punctuation and a following capital, quote or bracket.

    Abbreviations don't end sentences, not even as the end of a longer word, and
    come out in lower case; quotes and brackets that close a sentence go with
    the white space after it.
    """
    return clean([p.replace("\0", ".") for p in _parts(_ENDS, _shield(text))])


def arabic(text: str) -> list[str]:
    return [s for p in paragraphs(text) for s in clean(_parts(_ARABIC, p))]


def language(text: str) -> str:
    """Plain form of detect_language."""
    if text.isascii() or not _SCRIPT.search(text):
        return "en" if _LATIN.search(text) else "unknown"
    a, l = len(text) - len(_SCRIPTS.sub("", text)), len(text) - len(_LATINS.sub("", text))
    if a / (a + l) >= 0.6:
        return "ar"
    if l / (a + l) >= 0.6:
        return "en"
    return "mixed"


def arabic_form(text: str, config: ChunkerConfig) -> str:
    """Plain form of normalize_arabic."""
    if config.arabic_remove_tashkeel:
        text = _MARKS.sub("", text)
    table: dict[int, str] = {}
    if config.arabic_remove_tatweel:
        table[ord(TATWEEL)] = ""
    for on, (of, to) in (
        (config.arabic_normalize_alef, _ALEF),
        (config.arabic_normalize_yeh, YEH),
        (config.arabic_normalize_teh_marbuta, _TEH),
        (config.arabic_normalize_punctuation, PUNCTUATION),
    ):
        if on:
            table |= {ord(a): b for a, b in zip(of, to)}
    text = re.sub(r"[^\S\n]+", " ", text.translate(table))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def segment(text: str, lang: str, config: ChunkerConfig) -> list[str]:
    """Sentences by language: mixed texts line by line, each in its own."""
    if lang == "ar":
        return arabic(arabic_form(text, config))
    if lang != "mixed":
        return english(text)
    out = []
    for line in clean(text.split("\n")):
        out += arabic(arabic_form(line, config)) if language(line) == "ar" else english(line)
    return out


def _series(f):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t) for t in text], dtype=object)

    return run


def sentences_english(x: Column) -> Column:
    return _series(english)(x)


def _split(x: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(x, pattern, -1), strip), lambda s: s != "")


def sentences_fast(x: Column) -> Column:
    return _split(x, rf"(?<=[.!?؟])[{WS}]+")


def sentences_wider(x: Column) -> Column:
    return _split(x, rf"(?<=[.!?؟؛])[{WS}]+")


def sentences_arabic(x: Column) -> Column:
    """Of a text that is normalized already; paragraphs end sentences."""
    return F.flatten(F.transform(split_paragraphs(x), lambda p: _split(p, rf"(?<=[.!؟؛])[{WS}]+")))


def split_paragraphs(x: Column) -> Column:
    return _split(x, rf"\n[{WS}]*\n")


def sentences(x: Column, config: ChunkerConfig = ChunkerConfig()) -> Column:
    """By the detected language of each text."""
    return _series(lambda t: segment(t, language(t), config))(x)
