"""Corpus pipeline: from raw documents to token ids in five stages, each written as Parquet for the next.

Near copies go in stage 3: of each group the document of the least doc_id stays.
All stages but the last return the columns of documents; n_chars follows text.

Each stage begins by giving back the memory that executors and workers still
hold of the stages before, so that a stage's peak is its own.

Every stage takes nulls in any column, empty and very long texts, repeated rows,
further columns of any name and empty tables; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.bpe import encode, forget
from lamina.llm.common import cut, documents, give_back
from lamina.llm.line_dedup import line_dedup
from lamina.llm.mixing import mix
from lamina.llm.ngram_join import near_dedup
from lamina.llm.quality_rules import quality_filter


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def fresh(stage: Stage) -> Stage:
    """``stage`` after memory of earlier ones is given back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark, forget)
        return stage(spark, docs, sf_dir)

    return run


@fresh
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' combined votes find good. Null and empty texts vote as texts of no words; equal texts stay or go together."""
    return quality_filter(docs).select(*docs.columns)


@fresh
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines, with no text left if all are. Null texts and documents of no source stay as they are."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


@fresh
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: of the least doc_id, null ones last, and of its equal rows one. Documents without words stay."""
    return near_dedup(docs)


@fresh
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target weight asks; documents of no source are a source. Equal rows share what they get."""
    return mix(docs)


@fresh
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of text; null for a null text, none for an empty one."""
    return encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near),
    ("mixing", mixture),
    ("bpe", tokens),
]
#: EM, random rounding and the merges of BPE are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
