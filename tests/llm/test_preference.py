"""The pairwise quality ranking: gradient, pairs, held-out accuracy and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgauge.llm import preference, queries
from fieldgauge.llm.tables import workspace

K = len(preference.MEASURES)


def table(spark, values):
    return spark.createDataFrame([([float(v) for v in x], q) for x, q in values], "x array<double>, quality int")


def test_held_out_documents_are_told_apart(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op13_preference_quality(spark, "/root/testdata/sf0.01")
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == documents.count()
    rows = found.join(labels, "doc_id").where("held_out").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97
    assert ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()


def test_labels_of_held_out_documents_are_not_read(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    learn = queries.learnable(3, 1)
    spoiled = labels.withColumn("quality", F.when(learn, F.col("quality")).otherwise(1 - F.col("quality")))
    of = lambda held: {r["doc_id"]: r["score"] for r in preference.rank_quality(documents, held, learn, {"doc_id": F.col("doc_id")}).collect()}
    first, second = of(labels), of(spoiled)
    assert first.keys() == second.keys() and all(abs(first[d] - second[d]) < 1e-6 for d in first)


def test_sums_over_pairs_equal_the_formulas(spark):
    rng = np.random.default_rng(1)
    good, bad, weights = rng.normal(size=(40, K)), rng.normal(size=(40, K)), rng.normal(size=K)
    scale = np.full(K, 2.0)
    frame = spark.createDataFrame([(g.tolist(), b.tolist()) for g, b in zip(good, bad)], "good array<double>, bad array<double>").repartition(3)
    loss, gradient, curvature, n = preference._summed(frame, weights, scale)
    of = lambda w: np.log1p(np.exp(-((good - bad) / 2.0) @ w)).sum()
    assert n == 40 and loss == pytest.approx(of(weights))
    step = 1e-5
    slopes = [(of(weights + step * e) - of(weights - step * e)) / (2 * step) for e in np.eye(K)]
    assert np.allclose(gradient, slopes, atol=1e-5) and np.allclose(curvature, curvature.T)


@pytest.mark.parametrize("n_good, n_bad", [(7, 3), (3, 7), (5, 5), (9, 1)])
def test_every_row_of_the_larger_side_meets_the_other(spark, n_good, n_bad):
    good, bad = (spark.range(n).select(F.array(F.col("id").cast("double")).alias("x")).repartition(3) for n in (n_good, n_bad))
    pairs = [(g[0], b[0]) for g, b in preference._pairs(good, bad, n_good, n_bad, workspace(good, "pairs")).collect()]
    assert len(pairs) == preference.PAIRS_EACH * max(n_good, n_bad)
    larger = [p[0] if n_good >= n_bad else p[1] for p in pairs]
    assert all(larger.count(v) == preference.PAIRS_EACH for v in range(max(n_good, n_bad)))
    fewer = [p[1] if n_good >= n_bad else p[0] for p in pairs]
    counts = [fewer.count(v) for v in range(min(n_good, n_bad))]
    assert max(counts) - min(counts) <= preference.PAIRS_EACH


def test_threshold_lies_at_the_share_of_bad_rows(spark, tmp_path):
    rows = [([i] + [0] * (K - 1), int(i >= 4)) for i in range(10)]
    weights, threshold = preference.learn(table(spark, rows), str(tmp_path))
    assert weights[0] > 0 and 3 * weights[0] < threshold < 4 * weights[0]


@pytest.mark.parametrize("rows, share", [([], 0.5), ([(1, 1)] * 3, 3.5 / 4), ([(1, 0)] * 3, 0.5 / 4), ([(1, None), (1, 7)], 0.5)])
def test_one_label_or_none(spark, tmp_path, rows, share):
    weights, threshold = preference.learn(table(spark, [([v] * K, q) for v, q in rows]), str(tmp_path))
    assert weights == [0.0] * K and 1 / (1 + np.exp(threshold)) == pytest.approx(share)


def test_awkward_documents(spark, documents, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (7, 0), (None, 1), (10, 0), (8, 1), (8, 0)], "doc_id long, quality int")
    columns = {"doc_id": F.col("doc_id"), "x": F.col("words")}
    found = preference.rank_quality(documents, labels, F.lit(True), columns)
    rows = found.collect()
    assert found.columns == ["doc_id", "x", "score", "predicted"] and len(rows) == documents.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert preference.rank_quality(empty, labels, F.lit(True), columns).collect() == []
    assert preference.measures(None) == preference.measures("")
