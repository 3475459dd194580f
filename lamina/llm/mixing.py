"""Mixing sources to target weights by pivotal dependent rounding.

A source of n documents and weight w is to have total * w copies, so each of
its documents e = total * w / n of them: floor(e) for certain and one more with
the fractional part as probability. Pairs of documents pass that mass to each
other at random until one of the two is integral. Each leaf of at most LEAF
documents leaves one fractional document; these residuals meet in a tree of
FAN-wide nodes, first within their source, then across sources. So each source
gets its target rounded up or down, the total is rounded too, and each
document's expected number of copies is e exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import cut, documents, if_small

#: Without weights of its own, a source weighs its number of documents to this power: large ones are damped.
DAMPING = 0.5
LEAF, FAN, SEED = 20_000, 500, 20
_EPS = 1e-9


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds probabilities by duels in order; at most one entry stays fractional, and the sum stays."""
    p, held = p.copy(), -1
    draws = rng.random(len(p))
    for i in range(len(p)):
        b = p[i]
        if b <= _EPS or b >= 1 - _EPS:
            p[i] = round(b)
            continue
        if held < 0:
            held = i
            continue
        a, both = p[held], p[held] + b
        if both < 1:
            first = draws[i] * both < a  # the winner has the mass of both
            p[held], p[i] = (both, 0.0) if first else (0.0, both)
        else:
            first = draws[i] * (2 - both) < 1 - b  # the winner is certain, the other has what is left
            p[held], p[i] = (1.0, both - 1) if first else (both - 1, 1.0)
        left = held if _EPS < p[held] < 1 - _EPS else i if _EPS < p[i] < 1 - _EPS else -1
        for k in (held, i):
            if k != left:
                p[k] = round(p[k])
        held = left
    return p


def _duel(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["site", "key", "more"], kind="stable").reset_index(drop=True)
        name = f"{seed}/{pdf['level'][0]}/{pdf['site'][0]}/{pdf['node'][0]}"
        rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big"))
        return pdf.assign(p=pivotal(pdf["p"].to_numpy(), rng))

    return run


def _row_key(docs: DataFrame) -> tuple[Column, Column]:
    """Twice 64 bits of all columns. Nulls count, in nested columns too, and maps by their entries in order."""

    def parts(f) -> list[Column]:
        c = F.col(f"`{f.name}`")
        if any(k in f.dataType.simpleString() for k in ("map<", "array<", "struct<", "variant")):
            c = F.to_json(F.struct(c.alias("c")), {"ignoreNullFields": "false"})
        return [c.isNull(), c]

    every = [p for f in docs.schema.fields for p in parts(f)]
    return F.xxhash64(*every), F.xxhash64(F.lit(20), *every)


def copies(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, source: str = "source", seed: int = SEED) -> DataFrame:
    """(key, more, doc_id, site, rows, copies): copies of each different row of ``docs``, which key and more tell from others.

    ``weights`` are relative; sources they leave out get none. ``total`` is the
    number of rows of ``docs`` if not given. Rows of a null source are a source
    of their own, named by "" in ``weights``. Equal rows are one unit with the
    mass of all, ``rows`` of them. doc_id may be null, repeated, or absent, which
    is as if null. No rows give no rows.
    """
    site = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    key, more = _row_key(docs)
    units = docs.select(key.alias("key"), more.alias("more"), doc_id.alias("doc_id"), site.alias("site"))
    units = cut(units.groupBy("key", "more", "doc_id", "site").agg(F.count("*").alias("rows")))
    sizes = units.groupBy("site").agg(F.sum("rows").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow("n", F.lit(DAMPING)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "site string, w double")
        weighed = sizes.join(F.broadcast(given), "site", "left").fillna(0.0, ["w"])
    weighed = cut(weighed)
    sums = weighed.agg(F.sum("n"), F.sum("w"), F.max("n")).first()
    rows, mass, largest = (sums[0] or 0), (sums[1] or 0.0), (sums[2] or 0)
    rate = (rows if total is None else total) / mass if mass else 0.0
    each = weighed.select("site", "n", (F.lit(rate) * F.col("w") / F.col("n")).alias("e"))
    e = units.join(if_small(cut(each)), "site").withColumn("e", F.col("e") * F.col("rows"))
    whole = F.floor(F.col("e") + _EPS)
    start = cut(
        e.select(
            "key", "more", "doc_id", "site", "rows", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("e") - whole).alias("p"),
            F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / LEAF)).alias("node"),
        )
    )
    names = ["key", "more", "site", "p", "node", "level"]
    shape = "key long, more long, site string, p double, node long, level int"
    level, nodes = 0, max(1, -(-largest // LEAF))
    open_, taken = start.withColumn("level", F.lit(0)).select(*names), []
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        # Within a source first; its last residual then meets those of other sources.
        across = level and nodes == 0
        done = cut(open_.groupBy(*(["node"] if across else ["site", "node"])).applyInPandas(_duel(seed), shape))
        taken.append(done.filter("p = 1").select("key", "more"))
        rest = done.filter(fractional)
        level += 1
        if nodes > 1:
            nodes = -(-nodes // FAN)
            open_ = rest.withColumn("node", F.expr(f"node div {FAN}")).withColumn("level", F.lit(level)).select(*names)
            continue
        nodes = 0
        left = rest.count()
        if left <= 1:
            break
        open_ = rest.withColumn("node", F.pmod(F.xxhash64("site", F.lit(level)), F.lit(-(-left // FAN)))).withColumn("level", F.lit(level)).select(*names)
    final = [(r["key"], r["more"]) for r in rest.collect() if _coin(seed) < r["p"]]
    if final:
        taken.append(docs.sparkSession.createDataFrame(final, "key long, more long"))
    ups = taken[0]
    for t in taken[1:]:
        ups = ups.unionByName(t)
    # Each unit wins once at most.
    up = ups.withColumn("up", F.lit(1))
    found = start.join(up, ["key", "more"], "left").withColumn("copies", (F.col("whole") + F.coalesce("up", F.lit(0))).cast("int"))
    return found.select("key", "more", "doc_id", "site", "rows", "copies")


def _coin(seed: int) -> float:
    return float(np.random.default_rng(seed).random())


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, source: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` with each different row as many times as ``copies`` says; its columns stay as they are, whatever their names.

    Nulls in any column, empty and very long texts and maps make a row no less a
    row. Equal rows come as often as their common mass asks. An empty table
    stays empty.
    """
    found = cut(copies(docs, weights, total, source, seed).filter("copies > 0"))
    key, more = _row_key(docs)
    keyed = docs.withColumns({"__lamina_k": key, "__lamina_m": more})
    names = ["__lamina_k", "__lamina_m"]
    twice = cut(found.filter("rows > 1").select(F.col("key").alias(names[0]), F.col("more").alias(names[1])))
    if twice.limit(1).count():
        # Of equal rows one stands for all.
        held = if_small(twice)
        keyed = keyed.join(held, names, "left_anti").unionByName(keyed.join(held, names, "left_semi").dropDuplicates(names))
    marks = if_small(found).select(F.col("key").alias(names[0]), F.col("more").alias(names[1]), F.col("copies").alias("__lamina_c"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return keyed.join(marks, names).withColumn("__lamina_c", F.explode(F.expr("array_repeat(1, __lamina_c)"))).select(*columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents, for sources weighed by the square root of their size."""
    return mix(documents(spark, sf_dir))
