"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are scaled to unit length and rotated at random. Each curve takes a few
of the rotated coordinates, shifts them at random and orders the vectors by
their place on a Hilbert curve. That order is range-partitioned into blocks, by
quantiles of a sample; vectors that ask meet their own block and those within
reach on either side, and their best neighbours of all curves are merged and
ranked by similarity. A vector travels once for each curve, and once more for
each neighbouring block if it asks.

How many curves and how far they reach comes from the table: the exact
neighbours of PROBES random vectors, and how far apart each curve has them,
tell the recall of every choice. The cheapest that keeps RECALL is taken. All
pairs are one of the choices, so there always is one; it is the cheapest for
small tables, and for large ones whose vectors have no structure a curve could
follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm import tokens
from lamina.llm.common import cut, if_small

K = 10
#: Curves at most, coordinates each takes, bits of a coordinate on the curve, bits of a hash that part equal places (63 in all at most), vectors in a block at least and at most.
CURVES, AXES, BITS, SALT, BLOCK, LARGEST = 24, 6, 9, 9, 4096, 32_768
#: Recall to keep on the probes (0.9 is wanted of the table), probes, and vectors that tell how many lie between two places.
RECALL, PROBES, SAMPLE = 0.93, 200, 20_000
#: Sampled places for each block, that tell where it begins.
PLACES = 50
#: Comparisons that cost as much as one more copy of a vector.
COPY = 3000
SEED = 7
#: The rows that op1_hilbert_ann asks for, against all rows.
ASKS = "vec_id % 20 = 0"


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of non-negative integers below 2**bits (Skilling's transposition)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x0 = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
            x[0] = x0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, seed: int = SEED, curves: int = CURVES, axes: int = AXES, bits: int = BITS) -> np.ndarray:
    """A column of places for each curve."""
    d = unit.shape[1]
    rng = np.random.default_rng(seed)
    out = np.zeros((len(unit), curves), dtype=np.int64)
    axes = min(axes, d)
    pool = np.zeros((d, 0))
    for c in range(curves):
        if pool.shape[1] < axes:
            pool = np.linalg.qr(rng.standard_normal((d, d)))[0]
        basis, pool = pool[:, :axes], pool[:, axes:]
        # Coordinates of random unit vectors have deviation 1/sqrt(d); three of them fill the grid.
        at = np.clip(unit @ basis * np.sqrt(d) / 3, -1, 1) * 0.25 + 0.25 + 0.5 * rng.random(axes)
        out[:, c] = hilbert(np.minimum(np.floor(at * (1 << bits)), (1 << bits) - 1), bits)
    return out


def _places(unit: np.ndarray, ids: np.ndarray, seed: int, curves: int, axes: int, bits: int) -> np.ndarray:
    """``curve_keys``, with a hash of the id behind: so many equal vectors fill several blocks."""
    salt = tokens.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) >> np.uint64(64 - SALT)
    return curve_keys(unit, seed, curves, axes, bits) << SALT | salt.view(np.int64)[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _units(column: pd.Series, d: int) -> np.ndarray:
    return _scaled(np.array(column.tolist(), dtype=np.float64).reshape(-1, d))


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return _scaled(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))


def between(keys: np.ndarray, ids: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """The share of the sample that is before each row in a curve's order."""
    order = np.lexsort((ids, keys))
    out = np.empty(len(keys))
    out[order] = np.cumsum(sample[order]) - sample[order] / 2
    return out / max(1, sample.sum())


def choose(gaps: np.ndarray, n: int, block: int, share: float = 1.0, recall: float = RECALL) -> tuple[int, int, int, float]:
    """(curves, block, reach in blocks, expected recall): the cheapest that keeps ``recall``.

    gaps has a row for each probe and neighbour, and a column for each curve: how many of the n vectors are between them.
    ``share`` of the vectors ask.
    """
    size = min(n, LARGEST, max(block, -(-n // 16)))
    reach = max(0, -(-n // size) - 1)
    best = (COPY * (1 + share * reach) + share * n, 1, size, reach, 1.0)
    counts = sorted({gaps.shape[1], *[c for c in (1, 2, 3, 6, 12) if c < gaps.shape[1]]})
    span = float(block)
    while span < n:
        size = min(int(span), LARGEST)
        reach = math.ceil(span / size)
        missed = np.cumprod(1 - np.clip(reach + 1 - gaps / size, 0, 1), axis=1)
        for c in counts:
            cost = c * (COPY * (1 + 2 * share * reach) + share * min(n, (2 * reach + 1) * size))
            kept = 1 - float(missed[:, c - 1].mean())
            if kept >= recall and cost < best[0]:
                best = (cost, c, size, reach, kept)
        span *= 1.25
    return best[1:]


def _probe(good: DataFrame, n: int, d: int, k: int, curves: int, axes: int, block: int, seed: int, bits: int, share: float) -> tuple[int, int, int, float]:
    """What ``choose`` says of the table ``good``."""
    sample = good.select("id", "v").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(PROBES, min(SAMPLE, 10_000_000 // d))).toPandas()
    ids, unit = sample["id"].to_numpy(), _units(sample["v"], d)
    asked = good.sparkSession.sparkContext.broadcast((ids[:PROBES], unit[:PROBES]))

    def scan(batches):
        own, probes = asked.value
        held = None
        for pdf in batches:
            x = _units(pdf["v"], d)
            sim = np.round(probes @ x.T, 6)
            sim[own[:, None] == pdf["id"].to_numpy()[None, :]] = -2
            top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            p, c = np.repeat(np.arange(len(own)), top.shape[1]), top.ravel()
            rows = pd.DataFrame({"probe": p, "id": pdf["id"].to_numpy()[c], "s": sim[p, c], "v": list(x[c])})
            held = rows if held is None else pd.concat([held, rows])
            held = held[held["s"] > -2].sort_values(["probe", "s", "id"], ascending=[True, False, True]).groupby("probe").head(k)
        if held is not None:
            yield held

    found = good.select("id", "v").mapInPandas(scan, "probe int, id long, s double, v array<double>")
    nth = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("s"), "id"))
    true = found.withColumn("nth", nth).filter(F.col("nth") <= k).toPandas()
    keys = np.concatenate([_places(unit, ids, seed, curves, axes, bits), _places(_units(true["v"], d), true["id"].to_numpy(), seed, curves, axes, bits)])
    every, sampled = np.concatenate([ids, true["id"].to_numpy()]), np.arange(len(keys)) < len(ids)
    gaps = np.empty((len(true), curves))
    for c in range(curves):
        at = between(keys[:, c], every, sampled)
        gaps[:, c] = np.abs(at[len(ids) :] - at[true["probe"].to_numpy()]) * n
    return choose(gaps, n, block, share)


def _bounds(good: DataFrame, n: int, d: int, blocks: int, curves: int, axes: int, bits: int, seed: int) -> list[np.ndarray]:
    """For each curve the places at which blocks after the first begin: quantiles of about PLACES * blocks vectors, of all if there are fewer."""
    share = min(1.0, 1.5 * PLACES * blocks / n)
    some = good if share == 1 else good.filter(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def place(batches):
        for pdf in batches:
            keys = _places(_units(pdf["v"], d), pdf["id"].to_numpy(), seed, curves, axes, bits)
            for c in range(curves):
                yield pd.DataFrame({"curve": c, "place": keys[:, c]})

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        places = np.sort(pdf["place"].to_numpy())
        return pd.DataFrame({"curve": pdf["curve"].iloc[:1], "at": [places[np.arange(1, blocks) * len(places) // blocks].tolist()]})

    rows = some.select("id", "v").mapInPandas(place, "curve int, place long").groupBy("curve").applyInPandas(cuts, "curve int, at array<long>").collect()
    found = {r["curve"]: np.array(r["at"], dtype=np.int64) for r in rows}
    return [found.get(c, np.zeros(0, dtype=np.int64)) for c in range(curves)]


def _best(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, similarity): the best ``k`` of the others for each row, not itself. Single precision sorts out, double decides."""
    x32, y32 = x.astype(np.float32), y.astype(np.float32).T.copy()
    slack = np.float32(2e-6 + 2.4e-7 * x.shape[1])
    m = min(k + 1, len(other_ids))
    out = [[], [], []]
    step = max(1, 4_000_000 // max(1, len(other_ids)))
    for a in range(0, len(ids) if m else 0, step):
        sim = x32[a : a + step] @ y32
        least = np.partition(sim, len(other_ids) - m, axis=1)[:, len(other_ids) - m][:, None]
        r, c = np.nonzero(sim >= least - slack)
        r += a
        other = ids[r] != other_ids[c]
        r, c = r[other], c[other]
        s = np.empty(len(r))
        for i in range(0, len(r), 100_000):
            s[i : i + 100_000] = np.einsum("ij,ij->i", x[r[i : i + 100_000]], y[c[i : i + 100_000]])
        s = np.round(s, 6) + 0.0
        by = np.lexsort((other_ids[c], -s, r))
        r, c, s = r[by], c[by], s[by]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        for column, v in zip(out, (ids[r[keep]], other_ids[c[keep]], s[keep])):
            column.append(v)
    return tuple(np.concatenate([np.zeros(0, t), *column]) for t, column in zip((np.int64, np.int64, np.float64), out))


def nearest(
    vectors: DataFrame, k: int = K, curves: int = CURVES, axes: int = AXES, block: int = BLOCK, seed: int = SEED, bits: int = BITS, asks: str | None = None
) -> DataFrame:
    """(vec_id, rank, neighbour, similarity): ``k`` neighbours by cosine, to 6 places, of every vector for which ``asks`` holds, of all without it.

    All vectors can be neighbours. Ties go to the smaller vec_id; a vector isn't
    its own neighbour, but equal vectors of other ids are neighbours. Rows of a
    null vec_id, a null, empty or non-finite vector, or another length than most
    have neither neighbours nor place among them; of rows that share a vec_id the
    least vector counts. A vector of zeros is at similarity 0 to all. Other
    columns are ignored. ``curves`` is the most to use, ``block`` the least; up
    to ``block`` vectors, the result is exact. An empty table gives an empty one.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    ask = F.lit(True) if asks is None else F.coalesce(F.expr(asks), F.lit(False))
    good = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v"), ask.alias("ask")).filter("id is not null and size(v) > 0")
    good = good.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    shape = "id long, rank int, neighbour long, similarity double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], shape.replace("id", "vec_id", 1))
    d = lengths["d"]
    good = good.filter(F.size("v") == d)
    several = cut(good.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    if several.limit(1).count():
        held = if_small(several)
        once = good.join(held, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"), F.max("ask").alias("ask"))
        good = cut(good.join(held, "id", "left_anti").unionByName(once))
    n, asking = good.agg(F.count("*"), F.count_if("ask")).first()
    share = asking / n
    curves, block, reach, _ = _probe(good, n, d, k, curves, axes, block, seed, bits, share) if n > block else (1, n, 0, 1.0)
    blocks = -(-n // block)
    bound = vectors.sparkSession.sparkContext.broadcast(_bounds(good, n, d, blocks, curves, axes, bits, seed) if blocks > 1 else [np.zeros(0, dtype=np.int64)])
    names = ["curve", "block", "id", "v", "ask", "own"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, asked = batch.column(0), np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            keys = _places(_matrix(batch.column(1), d), ids.to_numpy(), seed, curves, axes, bits)
            for c in range(curves):
                home = np.searchsorted(bound.value[c], keys[:, c], side="right")
                for step in range(-reach, reach + 1):
                    rows = np.arange(batch.num_rows) if not step else asked[(home[asked] + step >= 0) & (home[asked] + step < blocks)]
                    if len(rows):
                        take, m = pa.array(rows), len(rows)
                        ask = batch.column(2).take(take) if not step else pa.array(np.ones(m, dtype=bool))
                        at = [pa.array(np.full(m, c, np.int32)), pa.array((home[rows] + step).astype(np.int64))]
                        yield pa.RecordBatch.from_arrays([*at, ids.take(take), batch.column(1).take(take), ask, pa.array(np.full(m, not step))], names=names)

    def compare(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), _matrix(table.column("v"), d)
        own, ask = table.column("own").to_numpy(), table.column("ask").to_numpy()
        return pa.table(dict(zip(("id", "neighbour", "similarity"), _best(ids[ask], x[ask], ids[own], x[own], k))))

    spread = good.select("id", "v", "ask").mapInArrow(place, f"curve int, block long, id long, v {kind}, ask boolean, own boolean")
    found = spread.groupBy("curve", "block").applyInArrow(compare, "id long, neighbour long, similarity double")
    best = F.sort_array(F.collect_set(F.struct((-F.col("similarity")).alias("s"), F.col("neighbour").alias("n"))))
    merged = found.groupBy("id").agg(F.slice(best, 1, k).alias("best"))
    return merged.select(F.col("id").alias("vec_id"), F.posexplode("best").alias("rank", "b")).select(
        "vec_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.n").alias("neighbour"), (-F.col("b.s") + F.lit(0.0)).alias("similarity")
    )


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K neighbours of every vector whose id is divisible by 20, among all vectors."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), asks=ASKS)


SQL = f"""
WITH u AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / n) AS v
  FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
), s AS (
  SELECT a.vec_id, b.vec_id AS neighbour, round(list_inner_product(a.v, b.v), 6) + 0.0 AS similarity
  FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.{ASKS}
), r AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS rank FROM s
)
SELECT vec_id, rank::INTEGER AS rank, neighbour, similarity FROM r WHERE rank <= {K}
"""
