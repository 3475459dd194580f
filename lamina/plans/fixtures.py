"""Texts with what the driver's tables lack: Arabic, Markdown, control characters, odd white space. They join the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS: list[str] = [
    "هذا نص باللغة العربية لاختبار كاشف اللغة. كيف حالك؟ أنا بخير؛ شكراً!",
    "كِتَابٌ أحمد تـــعـــلم ٪٥٠ ٫ ٬ آدم إلى مدرسةٌ، نعم",
    "Hello مرحبا world عالم mixed نص here هنا. One! اثنان؟ Three",
    "English line one. Another one.\nسطر عربي. سطر آخر؟ نعم.\n\n\nEnd line",
    "Hello    world\t\ttest   with NBSP\r\nand CR",
    "Hello\x01\x02 wor\x7fld\x85 control\x0b chars",
    "Hello\n\n\n\n\nworld\n \n \nagain",
    "Café with combining Å and ohm Ω",
    "# Title\nContent here. More of it.\n\n## Sub\nMore content\n\n- Item 1\n- Item 2\n  continued\n- Item 3\n\n| Col1 | Col2 |\n|------|------|\n| a | b |\n\n```python\ndef hello():\n    pass\n```\nDone.",
    "Setext\n======\n\ntext under it\n\n1. one\n2. two\n\n~~~\ncode\n~~~",
    "* star\n+ plus\n• bullet\n3) paren\n---\n***\n#nohash\n####### seven\n|notable\n| row |",
    'Dr. Smith met Mr. Jones. He said e.g. "Fine." (Really?) Yes! The U.S. Army came at 5 p.m. Then it trained. Next one.',
    "12345 67890",
    "   ",
    "",
    "No end",
    "a! b? c. D؟ e",
    "word " * 60,
]
#: Ids of these documents are -1 and down.
ROWS = [(-1 - i, t) for i, t in enumerate(TEXTS)]


def _literal(text: str) -> str:
    """SQL string of a text; control characters by number."""
    parts, held = [], ""
    for c in text:
        if ord(c) < 32 or 127 <= ord(c) < 160:
            parts += [f"'{held}'"] * bool(held) + [f"chr({ord(c)})"]
            held = ""
        else:
            held += "''" if c == "'" else c
    parts += [f"'{held}'"] * bool(held)
    return "(" + (" || ".join(parts) or "''") + ")"


#: DuckDB common table of the documents and these.
SQL = "docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_literal(t)})" for i, t in ROWS) + ") v(doc_id, text))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the documents and these."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return table.unionByName(spark.createDataFrame(ROWS, "doc_id long, text string"))
