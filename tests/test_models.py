"""Logistic fits against a plain Newton fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardpanel.operators import models as md


def table(spark, seed, n=1500, classes=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3)) * [1, 20, 0.1] + [5, 0, 0]
    push = (x - [5, 0, 0]) / [1, 20, 0.1] @ rng.normal(0, 1, (3, classes))
    y = (push + rng.gumbel(0, 1, push.shape)).argmax(axis=1)
    y = np.where((y == 1) & (rng.random(n) < 0.5), 0, y)
    rows = [(*map(float, r), int(k)) for r, k in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, y int")


def loss(w, z, y, weight, alpha):
    m = z @ w
    return (weight * (np.logaddexp(0, m) - y * m)).mean() + alpha / 2 * (w[:-1] ** 2).sum()


def newton(z, y, weight, alpha):
    w, keep = np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (weight * (p - y)) / len(y) + alpha * w * keep
        w = w - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z / len(y) + np.diag(alpha * keep) + 1e-12 * np.eye(len(w)), grad)
    return w


def scaled(x, ddof=0):
    return np.concatenate([(x - x.mean(0)) / x.std(0, ddof=ddof), np.ones((len(x), 1))], axis=1)


def balanced(y):
    return np.array([len(y) / (len(set(y.tolist())) * (y == c).sum()) for c in y.tolist()])


@pytest.mark.parametrize("shard", [20_000, 400])
def test_stochastic_fit_comes_close_to_the_converged_one(spark, shard, monkeypatch):
    monkeypatch.setattr(md, "SHARD_ROWS", shard)
    x, y, df = table(spark, 1)
    z, weight = scaled(x), balanced(y)
    best = loss(newton(z, y, weight, 1e-4), z, y, weight, 1e-4)
    model = md.fit_sgd_logistic(df, ["a", "b", "c"], "y")
    assert loss(model.weights[:, 0], z, y, weight, 1e-4) < best * 1.01


def test_same_fit_for_any_partitioning(spark):
    _, _, df = table(spark, 2, 600)
    one = md.fit_sgd_logistic(df.repartition(1), ["a", "b", "c"], "y", epochs=3)
    many = md.fit_sgd_logistic(df.unionByName(df.where("false")).repartition(7, "b"), ["a", "b", "c"], "y", epochs=3)
    np.testing.assert_allclose(one.weights, many.weights, rtol=1e-9)


def test_several_classes_and_bad_rows(spark):
    x, y, df = table(spark, 3, 900, 3)
    odd = spark.createDataFrame([(None, 1.0, 1.0, 1), (1.0, 1.0, 1.0, None)], "a double, b double, c double, y int")
    model = md.fit_sgd_logistic(df.unionByName(odd), ["a", "b", "c"], "y")
    got = model.transform(df, ["y"]).collect()
    assert len(got) == 900 and all(abs(sum(r.prob) - 1) < 1e-9 for r in got)
    assert np.mean([r.pred == r.y for r in got]) > np.bincount(y).max() / len(y) + 0.05
    with pytest.raises(ValueError):
        md.fit_sgd_logistic(df.where("y = 0"), ["a", "b", "c"], "y")


def test_default_penalty(spark):
    x, y, df = table(spark, 4, 300)
    model = md.fit_logistic(df, ["a", "b", "c"], "y").stages[-1]
    want = newton(scaled(x, 1), y, balanced(y), 1 / len(y))
    np.testing.assert_allclose(np.append(model.coefficients.toArray(), model.intercept), want, rtol=1e-3, atol=1e-3)


def test_ranking_areas_and_splits_read_their_input_few_times(spark):
    from wardpanel.operators import metrics as mt
    from wardpanel.operators import split as sp

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(600).selectExpr("id", "cast(id % 7 as double) / 7 + id as prob", "cast(id % 3 = 0 as int) as y", "id % 90 as who")
    watched = rows.mapInPandas(count, rows.schema)
    spark.conf.set("wardpanel.group.rows", "50")
    try:
        got = mt.ranking_areas(watched.select("y", "prob")).first()
        assert seen.value == 600 and got["positives"] == 200
        parts = sp.split_by_patient(watched, "who", (0.7, 0.3), 1).groupBy("split").agg({"who": "count"}).collect()
        assert seen.value == 3 * 600 and len(parts) == 2
        both = mt.shuffled_columns(rows, "id", ["prob", "y"], 4).orderBy("id").collect()
        one = mt.shuffled_column(rows, "id", "prob", 4).orderBy("id").collect()
        assert [r["prob__shuffled"] for r in both] == [r["prob"] for r in one] and sorted(r["y__shuffled"] for r in both) == sorted(r["y"] for r in both)
    finally:
        spark.conf.unset("wardpanel.group.rows")
