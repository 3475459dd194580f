"""Information-theoretic sanitisation of personal data.

Protected entities (mail and network addresses, phone, card and account
numbers, secrets) are found by their form and generalised to their class. Words
near them can reveal them too. The corpus tells how strongly: with p(c) the
share of word occurrences near an entity of class c, and p(c|t) that of term
t's occurrences, a term discloses

    PMI(t, c) / IC(c) = 1 + log p(c|t) / -log p(c)

of the class, where p(c|t) is the lower bound of its confidence interval, so
that chance meetings don't count. Wherever they are, in documents without
entities too, terms over GENERALISE are replaced by their kind, and terms over
REMOVE are removed; the window only serves to estimate.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import cut, documents, drop

#: Words on either side of an entity that count as near it.
NEAR = 5
#: Disclosure from which a term is generalised, or removed; meetings it must have; deviations of the interval.
GENERALISE, REMOVE, MEETINGS, DEVIATIONS = 0.75, 0.9, 2, 2.58
#: Terms that workers get to know; more are counted and looked up by joins instead, with the same words.
TERMS = 500_000

_ENTITIES = [
    ("EMAIL", r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"),
    ("SECRET", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\b)[\"']?\s*[=:]\s*(?:\"[^\"\n]{4,}\"|'[^'\n]{4,}'|[^\s\"',;]{6,})"),
    ("SECRET", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("SECRET", r"\b(?:gh[pousr]_\w{30,}|sk-[\w-]{20,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]*)"),
    ("SECRET", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)"),
    ("SECRET", r"\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}\b"),
    ("IP", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("ACCOUNT", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("CARD", r"(?<![\d.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"),
    ("NATIONAL_ID", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("PHONE", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"),
]
CLASSES = sorted({c for c, _ in _ENTITIES})
_ANY = re.compile("|".join(f"(?P<{c}_{i}>{p})" for i, (c, p) in enumerate(_ENTITIES)))
#: Each form has a digit, an @, or one of these.
_HINTS = (*"0123456789@", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ", "-----BEGIN")
_KEYS = ("passw", "pwd", "secret", "token", "key", "auth")
#: Digits of other scripts count as digits too.
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"\w+")


def _terms(text: str) -> list[str]:
    """The words of a text in lower case. Lower case comes last: it can split words and depends on what follows them."""
    return _WORD.findall(text.lower()) if text.isascii() else list(map(str.lower, _WORD.findall(text)))


def entities(text: str) -> list[tuple[int, int, str]]:
    """(from, to, class) of each protected entity, leftmost first, without overlaps."""
    if not any(h in text for h in _HINTS) and (text.isascii() or not _DIGIT.search(text)):
        low = text.lower()
        if not any(k in low for k in _KEYS):
            return []
    return [(m.start(), m.end(), m.lastgroup.rsplit("_", 1)[0]) for m in _ANY.finditer(text)]


def _before(text: str, at: int) -> list[re.Match]:
    """The last NEAR words before ``at``, whatever their length."""
    size = 40 * NEAR
    while True:
        start = max(0, at - size)
        found = list(_WORD.finditer(text, start, at))
        if start and found and found[0].start() == start:
            del found[0]  # it may have begun earlier
        if len(found) >= NEAR or not start:
            return found[-NEAR:]
        size *= 4


def _near(text: str, found: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, frozenset[str]]]:
    """(from, to, term, classes) of each word near an entity but not in one, each word once."""
    marks: dict[tuple[int, int], set[str]] = {}
    for a, b, c in found:
        left = _before(text, a)
        right = []
        for m in _WORD.finditer(text, b):
            right.append(m)
            if len(right) == NEAR:
                break
        for m in left + right:
            marks.setdefault(m.span(), set()).add(c)
    at = 0
    for (a, b), classes in sorted(marks.items()):
        while at < len(found) and found[at][1] <= a:
            at += 1
        inside = any(x < b and a < y for x, y, _ in found[max(0, at - 1) : at + 2])
        if not inside:
            yield a, b, text[a:b].lower(), frozenset(classes)


def disclosure(meetings: int, count: int, near: int, words: int) -> float:
    """How much of the class a term discloses: at most 1; 0 or less if it tells nothing."""
    if not (meetings and count and near and words) or near >= words:
        return 0.0
    p, n, z = min(1.0, meetings / count), max(count, meetings), DEVIATIONS
    low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return 1 + math.log(max(low, 1e-12)) / -math.log(near / words)


def disclosing(docs: DataFrame, copies: bool = True) -> DataFrame:
    """(term, class, d): the disclosure of terms over GENERALISE, counted over all documents. A cut.

    Without ``copies``, terms that meet the class once in one text, however many
    copies of it there are, are left out.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count: dict[tuple[str, str], list[int]] = {}
            for text in pdf["text"]:
                if not text:
                    continue
                found = entities(text)
                here = Counter((term, c) for _, _, term, classes in _near(text, found) for c in classes) if found else {}
                name = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) if here else 0
                for key, n in here.items():
                    now = count.setdefault(key, [0, 0, name, name])
                    now[:] = now[0] + n, max(now[1], n), min(now[2], name), max(now[3], name)
            yield pd.DataFrame([(*k, *v) for k, v in count.items()], columns=["term", "class", "n", "most", "low", "high"])

    text = docs.select("text").filter("text is not null")
    shape = "term string, class string, n long, most long, low long, high long"
    totals = [F.sum("n").alias("n"), F.max("most").alias("most"), F.min("low").alias("low"), F.max("high").alias("high")]
    met = cut(text.mapInPandas(meet, shape).groupBy("term", "class").agg(*totals))
    near = {r[0]: r[1] for r in met.groupBy("class").agg(F.sum("n")).collect()}
    often = met.filter(f"n >= {MEETINGS}")
    often = (often if copies else often.filter("most > 1 or low <> high")).select("term", "class", "n")
    names = often.select("term").distinct()
    known = None
    if names.count() <= TERMS:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in names.collect()))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count: Counter = Counter()
            words = 0
            for text in pdf["text"]:
                own = _terms(text)
                words += len(own)
                count.update(filter(known.value.__contains__, own) if known else own)
            # No term is empty, so that name is free for the number of all words.
            yield pd.DataFrame([("", words), *count.items()], columns=["term", "total"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["d"] = [disclosure(n, total, near[c], words) for n, total, c in zip(pdf["n"].tolist(), pdf["total"].tolist(), pdf["class"])]
            yield pdf.loc[pdf["d"] >= GENERALISE, ["term", "class", "d"]]

    totals = cut(text.mapInPandas(tally, "term string, total long").groupBy("term").agg(F.sum("total").alias("total")))
    words = (totals.filter("term = ''").agg(F.sum("total")).first()[0]) or 0
    out = cut(often.join(totals, "term").mapInPandas(judge, "term string, class string, d double"))
    drop(met)
    drop(totals)
    return out


def terms(docs: DataFrame) -> dict[tuple[str, str], float]:
    """(term, class) to its disclosure, of those over GENERALISE."""
    return {(r["term"], r["class"]): r["d"] for r in disclosing(docs).collect()}


def sanitise(text: str, known: dict[str, float]) -> tuple[str, int, int]:
    """The text with entities and the terms of ``known`` replaced, and how many of each there were."""
    found = entities(text)
    changes = [(a, b, f"[{c}]") for a, b, c in found]
    if known and not known.keys().isdisjoint(_terms(text)):
        at = 0
        for m in _WORD.finditer(text):
            word, (a, b) = m.group(), m.span()
            d = known.get(word.lower(), 0.0)
            if d < GENERALISE:
                continue
            while at < len(found) and found[at][1] <= a:
                at += 1
            if at < len(found) and found[at][0] < b:
                continue
            kind = "NUMBER" if word.isdigit() else "NAME" if word[:1].isupper() else "WORD"
            changes.append((a, b, "" if d >= REMOVE else f"[{kind}]"))
    if not changes:
        return text, 0, 0
    out, at = [], 0
    for a, b, new in sorted(changes):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), len(found), len(changes) - len(found)


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` sanitised, and n_entities and n_terms, how many were replaced.

    Rows and other columns stay, but those of the added names are replaced.
    Documents without entities and disclosing terms stay as they are. Null texts
    stay null, with 0 of each; equal texts become equal. Texts are read whole,
    whatever their length. A term of exactly GENERALISE is generalised, one of
    exactly REMOVE removed. An empty table gives an empty one.
    """
    docs = docs.drop("n_entities", "n_terms")
    strong = cut(disclosing(docs, copies=False).groupBy("term").agg(F.max("d").alias("d")))
    shape = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_entities", T.IntegerType()), T.StructField("n_terms", T.IntegerType())])

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=shape.names).astype({"text": object})

    if strong.count() <= TERMS:
        known = docs.sparkSession.sparkContext.broadcast({r["term"]: r["d"] for r in strong.collect()})

        @F.pandas_udf(shape)
        def clean(text: pd.Series) -> pd.DataFrame:
            return table([(None, 0, 0) if t is None else sanitise(t, known.value) for t in text])

        done = docs.withColumn("__lamina", clean("text"))
    else:

        @F.pandas_udf(shape)
        def clean_by(text: pd.Series, term: pd.Series, d: pd.Series) -> pd.DataFrame:
            given = [{} if x is None else dict(zip(x, y)) for x, y in zip(term, d)]
            return table([(None, 0, 0) if t is None else sanitise(t, k) for t, k in zip(text, given)])

        def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(0, len(pdf), 100):
                    rows = [(k, w) for k, t in zip(pdf["key"][i : i + 100], pdf["text"][i : i + 100]) for w in set(_terms(t))]
                    yield pd.DataFrame(rows, columns=["key", "term"])

        key = F.sha2("text", 256)
        spelled = docs.filter("text is not null").select(key.alias("key"), "text").mapInPandas(spell, "key string, term string")
        mine = spelled.join(strong, "term").distinct().groupBy("key").agg(F.collect_list(F.struct("term", "d")).alias("t"))
        mine = mine.select(F.col("key").alias("__lamina_key"), F.col("t.term").alias("__lamina_term"), F.col("t.d").alias("__lamina_d"))
        done = docs.join(mine, key == F.col("__lamina_key"), "left").withColumn("__lamina", clean_by("text", "__lamina_term", "__lamina_d"))
    return done.select(*[F.col("__lamina.text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "__lamina.n_entities", "__lamina.n_terms")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sanitised."""
    return sanitised(documents(spark, sf_dir).select("doc_id", "text"))
