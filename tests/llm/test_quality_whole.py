"""Quality training over every labelled row: exact quantiles, pairs that hold each row, weights, cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import quality as Q

ROWS = "place bigint, y int, raw array<double>"


def feature_rows(spark, n_good, n_bad, seed=5):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0.6, 1, (n_good, 3)), rng.normal(-0.4, 1, (n_bad, 3))]).round(2)
    rows = [(int(p), int(i < n_good), x[i].tolist()) for i, p in enumerate(rng.integers(-1 << 60, 1 << 60, len(x)))]
    return spark.createDataFrame(rows, ROWS).repartition(5), x


def test_order_values_are_exact(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1e3, (150, 2)), rng.normal(0, 1e-9, (150, 2)), np.zeros((40, 2)), -np.zeros((9, 2))])
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "raw array<double>").repartition(4)
    ranks = [0, 1, 100, 170, 180, 250, len(x) - 1]
    assert np.array_equal(Q.order_values(rows, "raw", ranks, 2), np.sort(x, axis=0)[ranks].T)
    at = np.linspace(0, 1, 10)[1:-1]
    assert np.allclose(Q.quantiles(rows, "raw", at, len(x), 2), np.quantile(x, at, axis=0).T, rtol=1e-12, atol=0)


@pytest.mark.parametrize("n_good,n_bad", [(500, 30), (30, 500), (200, 200), (300, 1)])
def test_every_row_is_in_a_pair(spark, monkeypatch, n_good, n_bad):
    monkeypatch.setattr(Q, "PART_ROWS", 60)
    monkeypatch.setattr(Q, "PART_LEAST", 12)
    monkeypatch.setattr(Q, "PAIRS", 1000)
    rows, x = feature_rows(spark, n_good, n_bad)
    pairs = Q.preference_pairs(rows, n_good, n_bad, 3).collect()
    assert len(pairs) >= 1000
    assert {tuple(r.good) for r in pairs} == set(map(tuple, x[:n_good].tolist()))
    assert {tuple(r.bad) for r in pairs} == set(map(tuple, x[n_good:].tolist()))


def test_weights_are_those_of_least_loss(spark):
    rows, x = feature_rows(spark, 60, 40)
    pairs = Q.preference_pairs(rows, 60, 40, 3).cache()
    model = Q.Ranker(x.mean(axis=0), x.std(axis=0), np.quantile(x, np.linspace(0, 1, Q.STEPS + 2)[1:-1], axis=0).T, None, 0.0, 0.3)
    got = Q.learned_weights(pairs, model)
    d = np.array([model.design(np.array([r.good]))[0] - model.design(np.array([r.bad]))[0] for r in pairs.sample(0.2, 1).collect()])
    full = model.design(x)
    z = (full[:60, None] - full[None, 60:]).reshape(-1, full.shape[1])
    slope = z.T @ (1 / (1 + np.exp(z @ got))) / len(z) - 1e-3 * got
    assert len(d) > 1000 and np.abs(slope).max() < 0.01  # random pairs stand for all of them


def test_training_takes_more_rows_than_any_cap(spark):
    """4,200 rows of a class: before, 3,000 of them were learnt from and cut by."""
    n_good, n_bad = 4200, 300
    docs = spark.range(n_good + n_bad).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") < n_good, F.concat_ws(" ", F.lit("a plain sentence of words,"), F.hex("id"), F.lit("and so on.")))
        .otherwise(F.concat_ws(" ", F.lit("BUY || BUY || $$$ !!!"), F.hex("id"), F.lit("BUY BUY"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") < n_good).cast("int").alias("quality"))
    rows = []
    pairs = Q.preference_pairs
    try:
        Q.preference_pairs = lambda r, *a: rows.append((r.count(), *a)) or pairs(r, *a)
        model = Q.train(docs, labels)
    finally:
        Q.preference_pairs = pairs
    assert rows == [(n_good + n_bad, n_good, n_bad, len(Q.features("")))]
    right = Q.score(Q.describe(docs), model).select((F.col("quality_score") >= 0.3) == (F.col("doc_id") < n_good))
    assert right.distinct().collect() == [(True,)]
    assert Q.score(docs, model).columns == ["doc_id", "text", "quality_score"]
