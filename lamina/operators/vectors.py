"""Vectors as array columns: cosine, breakpoints between neighbours, coherence, top-k search. All of it is built-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that may be broadcast to the vectors; of more, blocks are searched one after another.
QUERIES = 1_000


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where one of the two is all zeros."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def unit(a: Column) -> Column:
    """Scaled to length 1; zeros stay."""
    n = norm(a)
    return F.transform(_doubles(a), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))


def pairwise_distances(vectors: DataFrame, doc: str, pos: str, embedding: str = "embedding") -> DataFrame:
    """``vectors`` with ``distance`` to the next one of the same document; the last has none.

    One shuffle by document; each norm is computed once, before the window.
    """
    w = Window.partitionBy(doc).orderBy(pos)
    ready = vectors.withColumn("__lamina_unit", unit(F.col(embedding)))
    after = F.lead("__lamina_unit").over(w)
    return ready.withColumn("__lamina_next", after).withColumn(
        "distance", F.when(F.col("__lamina_next").isNotNull(), F.lit(1.0) - dot(F.col("__lamina_unit"), F.col("__lamina_next")))
    ).drop("__lamina_unit", "__lamina_next")


def _slopes(d: DataFrame, doc: str, pos: str) -> DataFrame:
    """With ``__lamina_g``: the size of the distance's central difference, one-sided at the ends."""
    w = Window.partitionBy(doc).orderBy(pos)
    before, after = F.lag("distance").over(w), F.lead("distance").over(w)
    slope = F.coalesce((after - before) / 2, after - F.col("distance"), F.col("distance") - before)
    return d.withColumn("__lamina_g", F.when(F.col("distance").isNotNull(), F.abs(slope)))


def _limit(kind: str, amount: float, over=lambda c: c) -> Column:
    """The threshold of a group's distances, or of a window's by ``over``; nulls don't count."""
    if kind == "standard_deviation":
        return over(F.avg("distance")) + F.lit(amount) * over(F.stddev_pop("distance"))
    if kind == "interquartile":
        low, high = over(F.percentile("distance", F.lit(0.25))), over(F.percentile("distance", F.lit(0.75)))
        return high + F.lit(amount) * (high - low)
    if kind == "gradient":
        return over(F.avg("__lamina_g")) + F.lit(amount)
    return over(F.percentile("distance", F.lit((amount if kind == "percentile" else 90.0) / 100)))


def thresholds(distances: DataFrame, doc: str, pos: str, kind: str = "percentile", amount: float = 90.0) -> DataFrame:
    """(doc, threshold) from ``distances``, which has doc, pos and distance; nulls don't count."""
    d = distances.filter("distance is not null")
    d = _slopes(d, doc, pos) if kind == "gradient" else d
    return d.groupBy(doc).agg(_limit(kind, amount).alias("threshold"))


def breakpoints(distances: DataFrame, doc: str, pos: str, kind: str = "percentile", amount: float = 90.0) -> DataFrame:
    """``distances`` with ``is_break``, whether a segment ends here. A document of a single distance has no gradient, so no break by it.

    Windows by document take the distances' own distribution: nothing is computed or shuffled again.
    """
    d = _slopes(distances, doc, pos) if kind == "gradient" else distances
    whole = Window.partitionBy(doc)
    limit = _limit(kind, amount, lambda c: c.over(whole))
    return d.withColumn("is_break", F.coalesce(F.col("distance") >= limit, F.lit(False))).drop("__lamina_g")


def segments(broken: DataFrame, doc: str, pos: str) -> DataFrame:
    """``broken`` with ``segment``, counted from 0 within the document; ``is_break`` ends one."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return broken.withColumn("segment", F.coalesce(F.sum(F.col("is_break").cast("int")).over(w), F.lit(0)).cast("int"))


def segment_texts(segmented: DataFrame, doc: str, pos: str, text: str = "text") -> DataFrame:
    """(doc, segment, text): texts of a segment joined by a space, in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda s: s[text]), " ")
    return segmented.groupBy(doc, "segment").agg(joined.alias(text))


def coherence(vectors: DataFrame, group: str, embedding: str = "embedding", dimension: int | None = None) -> DataFrame:
    """(group, n, coherence): mean cosine of different members; 1 for a single one.

    From the length of the sum of unit vectors: a sum for each dimension, no
    pairs. Map-side partial sums keep the shuffle at one vector a group and task.
    """
    if dimension is None:
        first = vectors.filter(F.col(embedding).isNotNull()).select(F.size(embedding)).first()
        dimension = first[0] if first else 1
    u = vectors.select(group, unit(F.col(embedding)).alias("u"))
    sums = [F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(dimension)]
    own = F.sum(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)).alias("own")
    g = u.groupBy(group).agg(F.count("*").alias("n"), own, *sums)
    whole = F.aggregate(F.array(*[F.col(f"s{i}") for i in range(dimension)]), F.lit(0.0), lambda s, x: s + x * x)
    value = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise((whole - F.col("own")) / (F.col("n") * (F.col("n") - 1)))
    return g.select(group, "n", value.alias("coherence"))


def search(vectors: DataFrame, query: list[float], k: int = 5, where: Column | str | None = None, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to one vector, with ``score`` (cosine) and ``distance``; ties go to the smaller key.

    The filter comes first; each partition sends k rows at most.
    """
    found = vectors.filter(where) if where is not None else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = found.withColumn("score", cosine_similarity(F.col(embedding), q)).withColumn("distance", F.lit(1.0) - F.col("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | str | None = None, key: str = "vec_id", query_key: str = "query_id") -> DataFrame:
    """(query_key, rank, key, score) of the ``k`` vectors nearest to each row of ``queries``, exactly.

    Each vector meets each query, so the work is their product. Queries are
    broadcast while there are few, else both sides meet partition by partition.
    """
    found = (vectors.filter(where) if where is not None else vectors).select(key, unit(F.col("embedding")).alias("__v"))
    asked = queries.select(query_key, unit(F.col("embedding")).alias("__q"))
    if asked.limit(QUERIES + 1).count() <= QUERIES:
        asked = F.broadcast(asked)
    scored = found.crossJoin(asked).select(query_key, key, dot(F.col("__v"), F.col("__q")).alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    # Spark limits each partition's groups to k before the shuffle.
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_key, "rank", key, "score")
