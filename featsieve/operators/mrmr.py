"""Greedy minimum-redundancy maximum-relevance ranking."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, functions as F

from ..functions import local_table


def abs_correlation(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """|corr| between features (p x p, one pass over the data); 0 where a side is constant."""
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    vectors = VectorAssembler(inputCols=numbers.columns, outputCol="v").transform(numbers).select("v")
    matrix = Correlation.corr(vectors, "v").head()[0].toArray()
    return np.nan_to_num(np.abs(matrix), nan=0.0)


def greedy_order(relevance: Sequence[float], corr: np.ndarray) -> list[tuple[int, float]]:
    """[(pos, gain)] in the order chosen: relevance minus mean |corr| with those chosen; the first best wins."""
    gains_of = np.asarray(relevance, float)
    redundancy, open_, out = np.zeros(len(gains_of)), np.ones(len(gains_of), bool), []
    for n_chosen in range(len(gains_of)):
        gain = np.where(open_, gains_of - redundancy / max(1, n_chosen), -np.inf)
        best = int(np.argmax(np.round(gain, 12)))
        out.append((best, float(gain[best])))
        open_[best] = False
        redundancy += corr[:, best]
    return out


def mrmr_scores(df: DataFrame, features: Sequence[str], relevance: DataFrame) -> DataFrame:
    """(pos, score, step) for relevance scores (pos, score); the loop runs over p numbers and a p x p matrix."""
    known = {r["pos"]: r["score"] for r in relevance.collect()}
    order = greedy_order([known.get(i, 0.0) for i in range(len(features))], abs_correlation(df, features))
    rows = [(pos, float(gain), step) for step, (pos, gain) in enumerate(order, start=1)]
    return local_table(df.sparkSession, rows, "pos int, score double, step int")
