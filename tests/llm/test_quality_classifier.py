"""The discriminant: held-out accuracy, and its density against a direct one."""

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from lamina.llm import quality_classifier as c
from lamina.llm.stats import FIELDS, text_stats


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(0)
    d = len(FIELDS)
    x = [rng.standard_normal((50, d)), rng.standard_normal((80, d)) * 0.5 + 1]
    model = c.fit(np.array([50.0, 80.0]), np.array([v.sum(axis=0) for v in x]), np.array([v.T @ v for v in x]))
    pooled = sum((len(v) - 1) * np.cov(v.T) for v in x) / 128
    log = []
    q = rng.standard_normal((20, d))
    for v, prior in zip(x, (51 / 132, 81 / 132)):
        cov = (1 - c.POOLED) * np.cov(v.T) + c.POOLED * pooled
        cov = (1 - c.DIAGONAL) * cov + c.DIAGONAL * np.diag(np.diag(cov)) + c.FLOOR * np.eye(d)
        z = q - v.mean(axis=0)
        log.append(np.log(prior) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)))
    assert np.allclose(model.score(q), log[1] - log[0])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").filter("quality is not null")
    stats = docs.select("doc_id", text_stats(F.col("text")).alias("__lamina_stats")).cache()
    model = c.train(stats, labels.filter("doc_id % 2 = 0"))
    held = c.score(stats, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "quality_score").collect()
    y, keep = np.array([r.quality for r in held]), np.array([r.quality_score for r in held]) >= c.THRESHOLD
    assert (y == keep).mean() >= 0.95
    assert keep[y == 1].mean() >= 0.97
    stats.unpersist()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat is here", 1.0), (2, None, 1.0), (3, "", 1.0), (None, "x", 1.0), (1, "the cat is here", 2.0)], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (1, 1, 0), (None, 1, 1), (9, 5, 0)], "doc_id long, quality int, toxic int")
    out = c.classify(docs, labels, float("-inf")).collect()
    assert len(out) == 5 and len({r.quality_score for r in out if r.doc_id == 1}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.quality_score for r in c.classify(docs, none).collect()} == {0.0}
    assert c.classify(docs.limit(0), labels).count() == 0
    one = c.classify(docs, labels.filter("quality = 1"), float("-inf"))
    assert one.count() == 5 and "text" not in one.columns
