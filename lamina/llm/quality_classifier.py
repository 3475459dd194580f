"""Quality classifier: regularised quadratic discriminant analysis.

Statistics of whole documents are transformed to be near to normal. Each class
has a mean and a covariance shrunk towards its diagonal and towards the pooled
covariance. A document's score is the difference of the classes' log densities:
Mahalanobis distances through Cholesky factors that are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import cut, documents
from lamina.llm.stats import FIELDS, text_stats

#: Shrinkage to the pooled covariance, and of the result to its diagonal.
POOLED, DIAGONAL = 0.1, 0.1
#: Added to each variance: no statistic is certain beyond this, so a constant one can't dominate.
FLOOR = 1e-3
#: Log-density difference from which a document counts as good.
THRESHOLD = 0.0


def transform(x: np.ndarray) -> np.ndarray:
    """Counts by logarithm, the rest by square root; columns as FIELDS."""
    return np.concatenate([np.log1p(x[:, :4]), np.sqrt(np.clip(x[:, 4:], 0, None))], axis=1)


@dataclass(frozen=True)
class Model:
    """Class means, inverse Cholesky factors, log determinants and log priors; index 1 is good."""

    means: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """log p(good, x) - log p(bad, x)."""
        log = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverse[c].T
            log.append(self.prior[c] - 0.5 * (self.logdet[c] + (z * z).sum(axis=1)))
        return log[1] - log[0]


def fit(count: np.ndarray, total: np.ndarray, square: np.ndarray) -> Model:
    """From each class's count, sums and sums of outer products.

    A class without examples takes the pooled mean and covariance, so only its
    prior tells it from the other; without any examples every score is 0.
    """
    d = total.shape[1]
    n = count.sum()
    mean = total.sum(axis=0) / max(n, 1)
    within = sum(square[c] - np.outer(total[c], total[c]) / max(count[c], 1) for c in (0, 1))
    pooled = within / max(n - 2, 1)
    means, inverse, logdet = [], [], []
    for c in (0, 1):
        m = total[c] / count[c] if count[c] else mean
        own = (square[c] - count[c] * np.outer(m, m)) / max(count[c] - 1, 1) if count[c] > 1 else pooled
        cov = (1 - POOLED) * own + POOLED * pooled
        cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(m)
        inverse.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    prior = np.log((count + 1) / (n + 2))
    return Model(np.array(means), np.array(inverse), np.array(logdet), prior)


def moments(features: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sums and sums of outer products by class of all labelled rows, added up partition by partition."""
    d = len(FIELDS)

    def part(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for pdf in batches:
            x, y = transform(pdf[FIELDS].to_numpy()), pdf["y"].to_numpy()
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                s[c] += own.sum(axis=0)
                q[c] += own.T @ own
        yield pd.DataFrame({"i": np.arange(2 * (1 + d + d * d)), "v": np.concatenate([n, s.ravel(), q.ravel()])})

    rows = (
        features.select("__lamina_stats.*", F.col(label).cast("int").alias("y"))
        .mapInPandas(part, "i int, v double")
        .groupBy("i")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    flat = np.zeros(2 * (1 + d + d * d))
    for r in rows:
        flat[r[0]] = r[1]
    return flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d)


def train(features: DataFrame, labels: DataFrame) -> Model:
    """``features``: doc_id and __lamina_stats. ``labels``: doc_id and quality, 0 or 1; other values and nulls don't count.

    A document of several labels counts once, as good if most of them say so;
    of a doc_id that several rows share, each row counts.
    """
    y = (
        labels.filter("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.expr("int(avg(quality) > 0.5)").alias("__lamina_y"))
    )
    return fit(*moments(features.select("doc_id", "__lamina_stats").join(y, "doc_id"), "__lamina_y"))


def score(features: DataFrame, model: Model) -> DataFrame:
    """Replaces __lamina_stats by quality_score; larger is better."""

    @F.pandas_udf("double")
    def scored(stats: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(transform(stats[FIELDS].to_numpy())))

    return features.withColumn("quality_score", scored("__lamina_stats")).drop("__lamina_stats")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score ``threshold`` or more, with quality_score; trained on all rows that ``labels`` covers.

    ``docs`` without its text: the statistics are taken once and kept, so that
    training and scoring don't read texts again. Null and empty texts have
    statistics of 0 and are scored like any other. Extra columns stay; one
    named quality_score is replaced. Equal texts score alike, and a score of
    exactly ``threshold`` is kept. Statistics are of whole texts, whatever their
    length; an empty table gives an empty one, and without labels all score 0.
    """
    stats = "__lamina_stats"
    features = cut(docs.drop("quality_score").withColumn(stats, text_stats(F.col("text"))).drop("text"))
    return score(features, train(features, labels)).filter(F.col("quality_score") >= threshold)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the classifier finds good, with its score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), labels)
