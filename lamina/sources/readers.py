"""Readers of HTML, EPUB, PDF and plain text into tables of documents.

Files are listed and read by Spark, so a missing path fails before any work
starts, and each file is parsed where it is read.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.errors import DependencyError

_NOISE = {"script", "style", "nav", "footer", "header", "aside", "form"}
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_TAKEN = {*_HEADINGS, "p", "li", "td", "th", "blockquote"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What an opening tag closes, as browsers do it; up to a tag of the second set.
_SHUTS = {
    **dict.fromkeys(["p", *_HEADINGS, "ul", "ol", "table", "blockquote", "div", "section", "article", "pre", *_NOISE - {"script", "style"}], ({"p"}, {"td", "th", "li", "blockquote", "div", "body"})),
    "li": ({"li"}, {"ul", "ol"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
}


class _Taker(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int | None]] = []
        self.parts: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _VOID:
            return
        if tag in _SHUTS:
            shut, walls = _SHUTS[tag]
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in shut:
                    del self.stack[i:]
                    break
                if self.stack[i][0] in walls:
                    break
        at = None
        if tag in _TAKEN:
            at = len(self.parts)
            self.parts.append((tag, []))
        self.stack.append((tag, at))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not any(t in _NOISE for t, _ in self.stack):
            for _, at in self.stack:
                if at is not None:
                    self.parts[at][1].append(text)


def read_html(page: str | None, heading_separator: str = "\n") -> str | None:
    """Text of headings, paragraphs, list items, cells and quotes in order, headings marked by hashes.

    Scripts, styles, navigation, headers, footers, asides and forms are left
    out, wherever they are. Text outside the named elements is, too; text in
    nested ones comes once for each. A paragraph ends where the next begins.
    """
    if page is None:
        return None
    taker = _Taker()
    taker.feed(page)
    taker.close()
    out = []
    for tag, texts in taker.parts:
        if text := " ".join(texts):
            level = _HEADINGS.get(tag)
            out.append(f"{'#' * level} {text}{heading_separator}" if level else text)
    return "\n\n".join(out)


@F.pandas_udf(T.StringType())
def _html(page: pd.Series) -> pd.Series:
    return pd.Series([read_html(p) for p in page], dtype=object)


def html_text(page: Column) -> Column:
    """Column form of read_html."""
    return _html(page)


def read_epub(data: bytes, chapter_separator: str = "\n\n---\n\n") -> str:
    """Documents of an EPUB that aren't blank, in its reading order, those it doesn't list after them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        order: list[str] = []
        package = next((n for n in names if n.endswith(".opf")), None)
        if package:
            root = ElementTree.fromstring(z.read(package))
            local = lambda e: e.tag.rpartition("}")[2]
            items = {e.get("id"): e.get("href") for e in root.iter() if local(e) == "item" and "html" in (e.get("media-type") or "")}
            at = posixpath.dirname(package)
            listed = [items.pop(e.get("idref"), None) for e in root.iter() if local(e) == "itemref"]
            order = [posixpath.normpath(posixpath.join(at, h)) for h in [*listed, *items.values()] if h]
        else:
            order = [n for n in names if n.lower().endswith((".html", ".xhtml", ".htm"))]
        found = [read_html(z.read(n).decode("utf-8", "replace")) for n in order if n in names]
    return chapter_separator.join(t for t in found if t.strip())


def pdf_backend() -> str | None:
    """The first PDF package that is installed here: pymupdf, pdfplumber or none."""
    for name in ("fitz", "pdfplumber"):
        try:
            __import__(name)
        except ImportError:
            continue
        return {"fitz": "pymupdf"}.get(name, name)
    return None


def read_pdf_pages(data: bytes, backend: str | None = None) -> list[str]:
    """Text of each page, blank ones too; none without a backend."""
    backend = backend or pdf_backend()
    if backend == "pymupdf":
        import fitz

        with fitz.open(stream=data, filetype="pdf") as doc:
            return [page.get_text() for page in doc]
    if backend == "pdfplumber":
        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as doc:
            return [page.extract_text() or "" for page in doc.pages]
    return []


def read_pdf(data: bytes, page_separator: str = "\n\n", backend: str | None = None) -> str:
    """Pages that aren't blank, joined."""
    if not (backend or pdf_backend()):
        raise DependencyError("reading PDF needs pymupdf or pdfplumber where the workers run")
    return page_separator.join(p for p in read_pdf_pages(data, backend) if p.strip())


def _files(spark: SparkSession, path: str, pattern: str | None, parse: Callable[[bytes], str | list[str]], pages: bool, errors: bool) -> DataFrame:
    """One file after another, so that a worker holds the text of one. With ``errors``, a file that can't be read is a row of a null text that tells why."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    names = ["source_file", *["page"] * pages, "text", *["error"] * errors]
    shape = ", ".join(f"{n} {'int' if n == 'page' else 'string'}" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                why = None
                try:
                    found = parse(bytes(content))
                except Exception as e:
                    if not errors:
                        raise
                    found, why = [None] if pages else None, f"{type(e).__name__}: {e}"
                rows = [(name, i, t, why) for i, t in enumerate(found)] if pages else [(name, 0, found, why)]
                yield pd.DataFrame(rows, columns=["source_file", "page", "text", "error"]).astype({"page": "int32", "text": object, "error": object})[names]

    return reader.load(path).select("path", "content").mapInPandas(run, shape)


def html_files(spark: SparkSession, path: str, pattern: str | None = "*.html", heading_separator: str = "\n", errors: bool = False) -> DataFrame:
    """(source_file, text) of HTML files; bytes that aren't UTF-8 are replaced."""
    return _files(spark, path, pattern, lambda b: read_html(b.decode("utf-8", "replace"), heading_separator), False, errors)


def epub_files(spark: SparkSession, path: str, pattern: str | None = "*.epub", chapter_separator: str = "\n\n---\n\n", errors: bool = False) -> DataFrame:
    return _files(spark, path, pattern, lambda b: read_epub(b, chapter_separator), False, errors)


def pdf_files(spark: SparkSession, path: str, pattern: str | None = "*.pdf", page_separator: str = "\n\n", backend: str | None = None, errors: bool = False) -> DataFrame:
    return _files(spark, path, pattern, lambda b: read_pdf(b, page_separator, backend), False, errors)


def pdf_pages(spark: SparkSession, path: str, pattern: str | None = "*.pdf", backend: str | None = None, errors: bool = False) -> DataFrame:
    """(source_file, page, text), pages counted from 0."""
    return _files(spark, path, pattern, lambda b: read_pdf_pages(b, backend), True, errors)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def in_memory(spark: SparkSession, texts: list[str], source_files: list[str] | None = None) -> DataFrame:
    """(doc_id, text, source_file) of a list; a shorter list of files is padded with empty names."""
    files = list(source_files or [])
    rows = [(i, t, files[i] if i < len(files) else "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source_file string")
