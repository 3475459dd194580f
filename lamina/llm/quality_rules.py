"""Quality rules under weak supervision.

Each rule votes that a document is bad (-1) or good (1), or abstains (0). The
votes of all documents are counted by pattern in Spark (at most 3**rules rows,
whatever the corpus), expectation-maximisation on these counts estimates how
often each rule votes so on good and on bad documents, and the posterior
probability of good quality replaces a filter that every rule must pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import documents
from lamina.llm.stats import text_stats

#: Documents of at least this posterior are kept.
KEEP = 0.5
ITERATIONS = 200
#: Pseudo-counts of each vote in each class, and how far the first guess trusts a rule.
SMOOTHING, TRUST = 1.0, 0.8
#: name, test for bad, test for good (None: it never votes so)
RULES: list[tuple[str, str, str | None]] = [
    ("capitals", "upper > 0.5", "upper < 0.15"),
    ("symbols", "symbols > 0.1", "symbols < 0.02"),
    ("exclaims", "exclaims > 0.3", None),
    ("pipes", "pipes > 0.3", None),
    ("adjacent", "adjacent > 0.3", "adjacent < 0.05"),
    ("repeated", "repeated > 0.4", "repeated < 0.2"),
    ("stop_words", "stop_words < 0.02 and n_words >= 20", "stop_words > 0.06"),
    ("word_length", "n_words > 0 and (word_length > 14 or word_length < 2)", "word_length between 3 and 10"),
    ("length", "n_words < 3", "n_words >= 50"),
]


def votes(stats: str = "stats") -> Column:
    """Array of the rules' votes from the struct column ``stats``."""

    def one(bad: str, good: str | None) -> Column:
        test = F.when(F.expr(bad), F.lit(-1))
        return (test.when(F.expr(good), F.lit(1)) if good else test).otherwise(F.lit(0)).cast("tinyint")

    def of(test: str | None) -> str | None:
        import re

        from lamina.llm.stats import FIELDS

        return test and re.sub(rf"\b({'|'.join(FIELDS)})\b", rf"`{stats}`.\1", test)

    return F.array(*[one(of(bad), of(good)) for _, bad, good in RULES])


def fit(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict]:
    """Posterior probability of good for each vote pattern, and the estimates.

    Expectation-maximisation with rules independent given the class. It starts
    from the vote sum, so that class 1 is what the rules call good. No patterns
    give no posteriors.
    """
    if not len(counts):
        return np.zeros(0), {"prior": 0.5, "votes": np.zeros((2, 0, 3))}
    score = patterns.sum(axis=1) - 3.0 * (patterns == -1).sum(axis=1)
    good = 1 / (1 + np.exp(-TRUST * score))
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(ITERATIONS):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = (weight[1].sum() + SMOOTHING) / (counts.sum() + 2 * SMOOTHING)
        table = np.einsum("cp,prv->crv", weight, onehot) + SMOOTHING
        table /= table.sum(axis=2, keepdims=True)
        log = np.einsum("prv,crv->cp", onehot, np.log(table)) + np.log([1 - prior, prior])[:, None]
        now = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(now - good).max() < 1e-9:
            good = now
            break
        good = now
    return good, {"prior": prior, "votes": table}


def score(docs: DataFrame) -> DataFrame:
    """``docs`` with ``p_quality``, the posterior probability that the document is good.

    Null and empty texts vote as texts of no words. Statistics are of whole
    texts, whatever their length. Extra columns stay, but a column named
    ``p_quality`` is replaced. Equal texts score alike; an empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    vote = "__lamina_votes"
    voted = docs.drop("p_quality").withColumn("__lamina_stats", text_stats(F.col("text"))).withColumn(vote, votes("__lamina_stats"))
    found = voted.groupBy(vote).agg(F.count("*").alias("n")).collect()
    found.sort(key=lambda r: tuple(r[0]))
    patterns = np.array([list(r[0]) for r in found], dtype=np.int8).reshape(len(found), len(RULES))
    posterior, _ = fit(patterns, np.array([r[1] for r in found], dtype=float))
    table = spark.createDataFrame(
        [(list(map(int, p)), float(q)) for p, q in zip(patterns, posterior)],
        f"{vote} array<tinyint>, p_quality double",
    )
    # At most 3**rules patterns, so the broadcast doesn't grow with the data.
    return voted.drop("__lamina_stats").join(F.broadcast(table), vote, "left").select(*[c for c in docs.columns if c != "p_quality"], "p_quality")


def quality_filter(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """Documents of posterior ``keep`` or more, with ``p_quality``."""
    return score(docs).filter(F.col("p_quality") >= keep)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the combined rules keep, with its posterior."""
    return quality_filter(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "p_quality")
