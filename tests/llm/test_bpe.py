"""Byte-pair encoding against another implementation, and round trips."""

import random

import pytest
import tiktoken
from conftest import DATA

from lamina.llm.bpe import PATTERN, VOCABULARY, decode, encode, load, read_ranks

ODD = ["", " ", "  ", " a", "a ", "a  b", "\n\n x\t", "don't we'll", "été 123 №", "日本語テキスト", "🙂🙃 x", "a" * 5000, "x.y,z. a, b.", "..", " .", "١٢٣", "é", "﻿bom", "a b  c"]


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})


def test_same_ids(other):
    bpe = load(VOCABULARY)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices(" \n\tabcXYZ.,'!?1é漢", k=rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        ids = bpe.encode(t).tolist()
        assert ids == other.encode_ordinary(t), t
        assert bpe.decode(ids) == t


def test_query_agrees_and_round_trips(spark, other):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    coded = encode(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in coded.collect():
        assert r.round_trip and r.n_tokens == len(r.ids)
        assert list(r.ids) == other.encode_ordinary(text[r.doc_id])
    assert {(r.doc_id, r.text) for r in decode(coded.drop("n_tokens", "round_trip")).collect()} == set(text.items())


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in enumerate([None, *ODD, *ODD[:3]])], "doc_id long, text string, n_tokens int, token string")
    out = encode(df)
    assert out.columns == ["doc_id", "token", "ids", "n_tokens", "round_trip"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].ids is None and rows[0].n_tokens is None and rows[0].round_trip is None
    assert rows[1].ids == [] and rows[1].n_tokens == 0
    back = {r.doc_id: r.text for r in decode(out).collect()}
    assert back == {i: t for i, t in enumerate([None, *ODD, *ODD[:3]])}
    assert encode(df.limit(0)).count() == 0
