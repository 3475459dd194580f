"""Column functions that tell language and script by the share of letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.text import WS

ARABIC = r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"


def letters(x: Column, kind: str) -> Column:
    """How many characters of ``x`` are in the class ``kind``.

    They are taken out: a long run of a negated class with several ranges costs about ten times as much.
    """
    return F.length(x) - F.length(F.regexp_replace(x, f"[{kind}]+", ""))


def some(x: Column, kind: str) -> Column:
    """Whether ``x`` has a character of ``kind``, a class without ASCII."""
    return (F.octet_length(x) > F.length(x)) & x.rlike(f"[{kind}]")


def detect_language(x: Column, arabic: float = 0.6, english: float = 0.6) -> Column:
    """ar, en, mixed or unknown. Latin letters of any language count as English; a null or blank text is unknown."""
    a, n = letters(x, ARABIC), letters(x, "a-zA-Z")
    both = a + n
    shares = F.when(a / both >= arabic, F.lit("ar")).when(n / both >= english, F.lit("en")).when(n > 0, F.lit("mixed")).otherwise(F.lit("unknown"))
    # Without Arabic letters the shares are 0 and 1, and nothing has to be counted.
    latin = "ar" if arabic <= 0 else "en" if english <= 1 else "unknown"
    return F.when(some(x, ARABIC), shares).when(x.rlike("[a-zA-Z]"), F.lit(latin)).otherwise(F.lit("unknown"))


def detect_script(x: Column) -> Column:
    """arabic, latin or mixed."""
    a, n = letters(x, ARABIC), letters(x, "a-zA-Z")
    share = a / (a + n)
    shares = F.when(share > 0.7, F.lit("arabic")).when(share < 0.3, F.lit("latin")).otherwise(F.lit("mixed"))
    return F.when(some(x, ARABIC), shares).when(x.rlike("[a-zA-Z]"), F.lit("latin")).otherwise(F.lit("mixed"))


def is_arabic(x: Column) -> Column:
    """Whether over half of the word characters are in the basic Arabic block."""
    basic = r"\x{600}-\x{6FF}"
    a, n = letters(x, basic), letters(x, r"\p{L}\p{N}_")
    return F.coalesce(some(x, basic) & (a / F.greatest(n, F.lit(1)) > 0.5) & (n > 0), F.lit(False))


def detect_segments(sentences: Column) -> Column:
    """Structs of each sentence and its language."""
    return F.transform(sentences, lambda s: F.struct(s.alias("sentence"), detect_language(s).alias("language")))


def blank(x: Column) -> Column:
    return x.isNull() | ~x.rlike(f"[^{WS}]")
