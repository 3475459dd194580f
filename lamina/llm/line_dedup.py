"""Line dedup by site-relative frequency.

Documents are grouped by host. A line is boilerplate on its host if it is on
more than RATIO of the host's pages, and on MIN_PAGES of them at least; then it
is dropped from all of them. The ratio alone would empty small hosts: of fewer
than 1 / RATIO pages, each line of each page is on more than RATIO of them. Only 64-bit hashes of lines are shuffled. A host
can have at most (distinct lines a page) / RATIO boilerplate lines, so their
table is small beside the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import cut, documents, if_small

#: Share of a host's pages above which a line is boilerplate, and pages it must be on.
RATIO, MIN_PAGES = 0.02, 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    """Of the line without white space around it; blank lines have none."""
    bare = F.regexp_replace(line, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(docs: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hashes): each host's boilerplate lines. A row is a page; a line counts once a page."""
    hashes = F.array_distinct(F.transform(_lines(F.col("text")), _hash))
    seen = (
        docs.filter(F.col(host).isNotNull() & F.col("text").isNotNull())
        .select(F.col(host).alias("host"), F.explode(hashes).alias("line"))
        .filter("line is not null")
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_pages)
    )
    pages = docs.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    return (
        seen.join(pages, "host")
        .filter(F.col("n") > ratio * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("hashes"))
    )


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``; rows and other columns stay.

    Lines compare without white space around them; blank lines always stay. A
    document all of whose lines go has an empty text. Null texts, and documents
    of a null host, stay as they are. Each of several equal rows counts as a page.
    A line on exactly ``ratio`` of the pages stays. Lines count and go whole,
    whatever the length of the text; an empty table stays empty; columns of any
    other name stay as they are.
    """
    found = cut(boilerplate(docs, host, ratio, min_pages))
    names = docs.columns
    marks = if_small(found, 100_000, 8 * F.size("hashes")).select(F.col("host").alias("__lamina_host"), F.col("hashes").alias("__lamina_hashes"))
    joined = docs.join(marks, F.col(host) == F.col("__lamina_host"), "left")
    hit = F.array_intersect(F.transform(_lines(F.col("text")), _hash), F.col("__lamina_hashes"))
    joined = joined.withColumn("__lamina_hit", F.when(F.col("__lamina_hashes").isNotNull(), hit))
    kept = F.filter(_lines(F.col("text")), lambda x: ~F.coalesce(F.array_contains(F.col("__lamina_hit"), _hash(x)), F.lit(False)))
    text = F.when(F.size("__lamina_hit") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*names)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source."""
    return line_dedup(documents(spark, sf_dir).select("doc_id", "source", "text"))


SQL = f"""
WITH bare AS (
  SELECT doc_id, source, i, line, regexp_replace(line, '^[ \\t\\r\\f\\x0B]+|[ \\t\\r\\f\\x0B]+$', '', 'g') AS b
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
), marks AS (
  SELECT source, b FROM bare JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) USING (source)
  WHERE b <> '' GROUP BY source, b, pages
  HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) > {RATIO} * pages
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
  FROM bare LEFT JOIN (SELECT source, b, 1 AS hit FROM marks) USING (source, b) WHERE hit IS NULL GROUP BY doc_id
)
SELECT doc_id, source, coalesce(kept.text, '') AS text FROM documents LEFT JOIN kept USING (doc_id)
"""
