"""Rankers built on linear models: penalised logistic coefficients and recursive elimination."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from .batch_logistic import BatchLogistic, Problem, weighted_f1
from ..functions import local_table
from .split import stratified_folds
from .target import with_class_weight


def scores_frame(df: DataFrame, scores: Sequence[float]) -> DataFrame:
    """(pos, score) from one number per feature."""
    return local_table(df.sparkSession, [(i, float(s)) for i, s in enumerate(scores)], "pos int, score double")


def assembled(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """keep columns + a ``features`` vector in feature order."""
    numbers = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(numbers).select(*keep, "features")


def logistic_scores(df: DataFrame, label: str, features: Sequence[str], c: float = 1.0, l1_ratio: float = 1.0, max_iter: int = 200) -> DataFrame:
    """Mean absolute coefficient over classes of a class-balanced logistic regression.

    regParam = 1 / (C * sum of weights) with no internal standardisation gives the
    objective C * sum(loss) + penalty; balanced weights sum to the row count.
    """
    weighted = with_class_weight(df.select(F.col(label).cast("double").alias("label"), *[F.col(f"`{f}`") for f in features]), "label")
    data = assembled(weighted, features, "label", "weight").persist()
    n = data.count()
    model = LogisticRegression(
        weightCol="weight", regParam=1.0 / (c * n), elasticNetParam=l1_ratio, standardization=False, maxIter=max_iter, tol=1e-6,
    ).fit(data)
    data.unpersist()
    return scores_frame(df, np.abs(model.coefficientMatrix.toArray()).mean(axis=0))


def logistic_input(df: DataFrame, label: str, features: Sequence[str], member) -> DataFrame:
    """x, y, member rows for BatchLogistic."""
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    return df.select(x.alias("x"), F.col(label).cast("int").alias("y"), member.cast("bigint").alias("member"))


def class_count(df: DataFrame, label: str) -> int:
    return int(df.agg(F.max(F.col(label).cast("int"))).head()[0]) + 1


def _weakest(features: tuple[int, ...], w: np.ndarray) -> int:
    """Index of the feature with the least squared weight."""
    return int(np.argmin((w[:, :-1] ** 2).sum(axis=0)))


def _eliminate(batch: BatchLogistic, problems: list[Problem], stop: int, on_fit=None) -> tuple[list[Problem], list[list[int]]]:
    """Drop the weakest feature of every problem, in step, until ``stop`` are left; (what is left, dropped in order)."""
    dropped: list[list[int]] = [[] for _ in problems]
    weights = None
    while True:
        size = len(problems[0].features)
        if size <= stop and on_fit is None:
            return problems, dropped
        weights = batch.fit(problems, weights)
        if on_fit is not None:
            on_fit(size, problems, weights)
        if size <= stop:
            return problems, dropped
        for i, q in enumerate(problems):
            at = _weakest(q.features, weights[i])
            dropped[i].append(q.features[at])
            problems[i] = Problem(q.features[:at] + q.features[at + 1:], q.rows)
            weights[i] = np.delete(weights[i], at, axis=1)


def elimination_scores(df: DataFrame, label: str, key: str, features: Sequence[str], seed: int = 42, folds: int = 0) -> DataFrame:
    """Recursive elimination, score = -ranking (kept features tie at -1).

    Half of the features are kept; with ``folds`` the size with the best summed
    weighted F1 over stratified folds is kept instead.
    """
    p = len(features)
    k = class_count(df, label)
    everything = tuple(range(p))
    all_bit = folds  # bits 0..folds-1: training rows of each fold
    if folds:
        folded = stratified_folds(df.select(key, label, *features), label, key, folds, seed, "_fold")
        member = F.lit(1 << all_bit)
        for b in range(folds):
            member = member + F.when(F.col("_fold") != b + 1, 1 << b).otherwise(0)
    else:
        folded, member = df, F.lit(1)
    data = logistic_input(folded, label, features, member).persist()
    batch = BatchLogistic(data, k, p)
    keep = max(1, p // 2)
    if folds:
        total: dict[int, float] = {}

        def note(size: int, problems: list[Problem], weights: list[np.ndarray]) -> None:
            total[size] = sum(weighted_f1(m) for m in batch.confusion(problems, weights))

        _eliminate(batch, [Problem(everything, b) for b in range(folds)], 1, note)
        keep = min(total, key=lambda size: (-round(total[size], 12), size))
    _left, dropped = _eliminate(batch, [Problem(everything, all_bit)], keep)
    data.unpersist()
    ranking = [1] * p
    for step, feature in enumerate(reversed(dropped[0]), start=2):
        ranking[feature] = step
    return scores_frame(df, [-r for r in ranking])
