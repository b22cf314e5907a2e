"""Linear machines fitted in shared passes against numpy on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featsieve.operators.batch_logistic import Problem
from featsieve.operators.linear import logistic_input
from featsieve.operators.linear_svm import BatchMultiMargin, BatchSquaredHinge, LinearModel, margin_slopes


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 3, 210)
    x = np.column_stack([y + rng.normal(0, 0.8, 210), rng.normal(size=210), (y == 1) * 2 + rng.normal(0, 1, 210)])
    fold = np.arange(210) % 3
    df = spark.createDataFrame([(int(a), *map(float, b), int(f)) for a, b, f in zip(y, x, fold)], "y int, a double, b double, c double, fold int").repartition(5).persist()
    return df, x, y, fold


def member():
    return F.when(F.col("fold") == 0, 1).otherwise(3)


@pytest.mark.parametrize("classes", [2, 3])
def test_squared_hinge_reaches_the_optimum(rows, classes):
    df, x, y, fold = rows
    df, y = df.withColumn("y", F.least("y", F.lit(classes - 1))), np.minimum(y, classes - 1)
    batch = BatchSquaredHinge(logistic_input(df, "y", ["a", "b", "c"], member()), classes, 3, 0.7)
    problems = [Problem((0, 1, 2), 0), Problem((0, 2), 1)]
    found = batch.fit(problems)
    for q, w in zip(problems, found):
        own = np.ones(210, bool) if q.rows == 0 else fold != 0
        xs, ys = np.column_stack([x[own][:, q.features], np.ones(own.sum())]), y[own]
        weight = own.sum() / (classes * np.bincount(ys))
        for h in range(len(w)):
            t = np.where(ys == (1 if classes == 2 else h), 1.0, -1.0)
            s = 0.7 * (weight[ys] if classes == 2 else np.where(t > 0, weight[h], 1.0))
            value = lambda v: v @ v / 2 + (s * np.maximum(0, 1 - t * (xs @ v)) ** 2).sum()
            grad = w[h] + xs.T @ (2 * s * np.where(t * (xs @ w[h]) < 1, xs @ w[h] - t, 0))
            assert np.abs(grad).max() < 1e-5
            assert all(value(w[h]) <= value(w[h] + d) for d in np.random.default_rng(1).normal(0, 0.01, (20, xs.shape[1])))
    judged = batch.confusion(problems, found)
    assert judged[0].sum() == 0 and judged[1].sum(axis=1).tolist() == np.bincount(y[fold == 0]).tolist()
    assert np.trace(judged[1]) > 0.6 * judged[1].sum()


@pytest.mark.parametrize("classes", [2, 3])
def test_multi_margin_loss_is_near_the_least(rows, classes):
    df, x, y, fold = rows
    df, y = df.withColumn("y", F.least("y", F.lit(classes - 1))), np.minimum(y, classes - 1)
    batch = BatchMultiMargin(logistic_input(df, "y", ["a", "b", "c"], member()), classes, 3)
    problems = [Problem((0, 1, 2), 0)]
    found = batch.fit(problems)
    xs = np.column_stack([x, np.ones(210)])
    heads = 1 if classes == 2 else 3

    def loss(w):
        return margin_slopes(xs @ w.T, y, 1.0, heads)[1] / 210 + batch.decay / 2 * (w[:, :-1] ** 2).sum()

    assert batch.losses(problems, found)[0] == pytest.approx(loss(found[0]))
    # numpy: sub-gradient descent for a long time, the best value met
    w, best = np.zeros((heads, 4)), np.inf
    for step in range(1, 10_001):
        g = margin_slopes(xs @ w.T, y, 1.0, heads)[0].T @ xs / 210
        g[:, :-1] += batch.decay * w[:, :-1]
        w = w - 1.0 / step**0.5 * g
        best = min(best, loss(w))
    assert loss(found[0]) <= 1.01 * best


def test_multi_margin_slopes_by_hand():
    push, loss = margin_slopes(np.asarray([[1.0, 0.5, -3.0]]), np.asarray([0]), 1.0, 3)
    assert loss == pytest.approx(0.5 / 3) and push.tolist() == [[-1 / 3, 1 / 3, 0.0]]


def test_linear_model_predicts_by_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (-1.0, -1.0)], "`a.b` double, c double")
    w = np.asarray([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [-1.0, -1.0, 0.0]])
    assert [r.prediction for r in LinearModel(["a.b", "c"], w).transform(df).collect()] == [0.0, 1.0, 2.0]
    assert [r.prediction for r in LinearModel(["a.b"], np.asarray([[2.0, 0.5]])).transform(df).collect()] == [1.0, 1.0, 0.0]
