"""Column functions over text: normalization, size estimates, line kinds, structure flags, hashes.

All are built-in expressions but NFC, which Spark lacks. Counts of characters
are lengths of what a replacement leaves, as regexp_count would collect every
match in an array. The white-space class is spelled out, so that it means the
same here, in Python and in SQL.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.config import ChunkerConfig

#: White space inside a character class, and the same without the newline.
WS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK = r"\t\x0B-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: All of WS, one by one.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
TASHKEEL = r"[\x{610}-\x{61A}\x{64B}-\x{65F}\x{670}\x{6D6}-\x{6DC}\x{6DF}-\x{6E8}\x{6EA}-\x{6ED}\x{FE70}-\x{FE7F}]"
TATWEEL = "ـ"
ALEF = ("آأإٱ", "ا" * 4)
YEH = ("ى", "ي")
TEH = ("ة", "ه")
PUNCTUATION = ("٪٫٬،", "%.,,")
#: Lines that hold a construct, for texts taken as English and as Arabic. (?d) leaves only \n as a line end.
FLAGS_EN = {
    "has_headers": rf"^#+[{WS}]+.+$|^.+\n[=\-]{{3,}}$",
    "has_tables": r"^\|.*\|$",
    "has_code": r"```[\s\S]*?```|~~~[\s\S]*?~~~",
    "has_lists": rf"^[{WS}]*[-*+][{WS}]+.+$|^[{WS}]*\d+\.[{WS}]+.+$",
}
FLAGS_AR = {
    "has_headers": rf"^#+[{WS}]+.+$",
    "has_tables": r"^\|.*\|$",
    "has_code": r"```[\s\S]*?```",
    "has_lists": rf"^[{WS}]*[-*+•][{WS}]+.+$|^[{WS}]*\d+[.)][{WS}]+.+$",
}
#: Kinds of a stripped line, the first that matches.
LINES = [
    ("header", rf"^#{{1,6}}[{WS}]+"),
    ("table_row", r"^\|.*\|$"),
    ("list_item", rf"^[-*+•][{WS}]+|^\d+[.)][{WS}]+"),
    ("code_fence", r"^(```|~~~)"),
    ("hr", r"^[-*_]{3,}$"),
]


def strip(x: Column) -> Column:
    """Without white space at both ends; trim() alone would only see U+0020."""
    return F.btrim(x, F.lit(SPACES))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([t if t is None else unicodedata.normalize(f, t) for t, f in zip(text, form)], dtype=object)


def unicode_form(x: Column, form: str = "NFC") -> Column:
    """``x`` in a Unicode normal form. Only rows that NFC could change go to Python: all below U+0300 is composed already."""
    risky = x.rlike(r"[^\x00-\x{2FF}]") if form == "NFC" else x.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_composed(F.when(risky, x), F.lit(form)), x)


def strip_control(x: Column) -> Column:
    return F.regexp_replace(x, CONTROL, "")


def collapse_spaces(x: Column) -> Column:
    return _single(x, BLANK)


def _single(x: Column, kind: str) -> Column:
    """Runs of ``kind``, a class with U+0020, as single spaces. Runs that are one already, which most are, don't match."""
    return F.regexp_replace(x, rf"[{kind.replace(r'\x20', r'\x1F')}][{kind}]*| [{kind}]+", " ")


def cap_newlines(x: Column, most: int = 2) -> Column:
    return F.regexp_replace(x, rf"\n{{{most + 1},}}", "\n" * most)


def clean_whitespace(x: Column) -> Column:
    return strip(cap_newlines(collapse_spaces(x)))


def normalize_text(x: Column, form: str | None = "NFC", control: bool = True, spaces: bool = True, newlines: int = 2) -> Column:
    """Composed, without control characters, with single spaces and at most ``newlines`` line ends together. Null stays null."""
    x = unicode_form(x, form) if form else x
    x = strip_control(x) if control else x
    x = cap_newlines(collapse_spaces(x), newlines) if spaces else x
    return strip(x)


def _python(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern))


_CONTROL, _BLANKS = _python(CONTROL), _python(f"[{BLANK}]+")
#: Blanks that aren't U+0020.
_ODD = _python(f"[{BLANK.replace(r'\x20', r'\x1F')}]")


def normalized(text: str) -> str:
    """normalize_text of a single text."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = _CONTROL.sub("", text)
    # Most texts need none of the rest, and it is cheap to tell.
    if "  " in text or _ODD.search(text):
        text = _BLANKS.sub(" ", text)
    if "\n\n\n" in text:
        text = re.sub(r"\n{3,}", "\n\n", text)
    return text.strip()


def normalize_arabic(x: Column, config: ChunkerConfig = ChunkerConfig()) -> Column:
    """Folding of Arabic letters and marks by the flags of ``config``, then clean_whitespace."""
    if config.arabic_remove_tashkeel:
        x = F.regexp_replace(x, TASHKEEL, "")
    pairs = [
        (config.arabic_remove_tatweel, (TATWEEL, "")),
        (config.arabic_normalize_alef, ALEF),
        (config.arabic_normalize_yeh, YEH),
        (config.arabic_normalize_teh_marbuta, TEH),
        (config.arabic_normalize_punctuation, PUNCTUATION),
    ]
    # translate() maps in one pass; letters beyond the target's length are removed.
    kept = [p for on, p in pairs if on and p[1]]
    gone = "".join(p[0] for on, p in pairs if on and not p[1])
    if kept or gone:
        x = F.translate(x, "".join(p[0] for p in kept) + gone, "".join(p[1] for p in kept))
    return clean_whitespace(x)


def estimate_tokens(x: Column, language: Column | str = "en") -> Column:
    """Characters by 3, for Arabic by 2.5, at least 1; an empty text has 0."""
    language = F.lit(language) if isinstance(language, str) else language
    n = F.length(x)
    each = F.when(language == "ar", F.floor(n * 2 / 5)).otherwise(F.floor(n / 3))
    return F.when(n > 0, F.greatest(F.lit(1), each)).when(n == 0, F.lit(0)).cast("int")


def sizing_tokens(x: Column) -> Column:
    """As strategies count: blind to language, an empty text has 1."""
    return F.when(x.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(x) / 3))).cast("int")


def rough_tokens(x: Column, per: int = 4) -> Column:
    """Characters by ``per``: 4 for English, 3 for Arabic; at least 1."""
    return F.when(x.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(x) / per))).cast("int")


def count_sentences(x: Column) -> Column:
    """Characters that end sentences, at least 1; an empty text has 0."""
    ends = F.length(F.regexp_replace(x, "[^.!?؟]+", ""))
    return F.when(F.length(x) > 0, F.greatest(F.lit(1), ends)).when(F.length(x) == 0, F.lit(0)).cast("int")


def count_words(x: Column) -> Column:
    # Words are a space apart then, so there is one more of them than of spaces.
    apart = F.trim(_single(x, WS))
    return (F.length(apart) - F.length(F.replace(apart, F.lit(" "), F.lit(""))) + (apart != "").cast("int")).cast("int")


def truncate_text(x: Column, most: int = 200) -> Column:
    """At most ``most`` characters, cut at a space if there is one, and dots."""
    cut = F.regexp_replace(F.substring(x, 1, most), r"(?s) [^ ]*\z", "")
    return F.when(F.length(x) <= most, x).otherwise(F.concat(cut, F.lit("...")))


def overlap_boundary(x: Column, tokens: int, language: Column | str = "en") -> Column:
    """The end of ``x`` that the next chunk repeats, from the first sentence that begins there."""
    if tokens <= 0:
        return F.when(x.isNotNull(), F.lit(""))
    language = F.lit(language) if isinstance(language, str) else language
    n = F.when(language == "ar", F.lit(tokens * 3)).otherwise(F.lit(tokens * 4))
    end = F.right(x, n)
    after = F.regexp_replace(end, rf"(?s)\A.*?(?<=[.!?؟])[{WS}]+", "")
    return F.when(F.length(x) <= n, x).otherwise(strip(after))


def line_element(x: Column) -> Column:
    """header, table_row, list_item, code_fence or hr; null for other lines."""
    bare = strip(x)
    kind = None
    for name, pattern in LINES:
        hit = bare.rlike(f"(?d){pattern}")
        kind = F.when(hit, F.lit(name)) if kind is None else kind.when(hit, F.lit(name))
    return kind


def structure_flags(x: Column, language: str = "en") -> dict[str, Column]:
    """Whether ``x`` has headers, tables, code and lists."""
    return {name: x.rlike(f"(?dm){p}") for name, p in (FLAGS_AR if language == "ar" else FLAGS_EN).items()}


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def cache_key(x: Column, model: Column | str | None = None) -> Column:
    """Key of an embedding, of its model and text, or of a language, of the text alone."""
    if model is None:
        return F.md5(x)
    return F.md5(F.concat_ws(":", F.lit(model) if isinstance(model, str) else model, x))
