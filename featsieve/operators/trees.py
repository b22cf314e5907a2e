"""Rankers built on tree ensembles: forest importance, boosting, shadow features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import boosting, forest
from .binned import Blocks, fit_edges, to_blocks
from .linear import class_count, scores_frame
from .shadows import ranked_rows, shadow_blocks, with_shadows

# fixed values: the second boosting parameter set
BALANCED_BOOSTING = {"rounds": 300, "depth": 5, "rate": 0.1, "rows": 1.0, "columns": 1.0, "l2": 0.0, "min_hessian": 1e-3, "min_rows": 20, "balanced": True, "importance": "split"}
SHADOW_ROWS = 30_000_000  # rows of all shadow rounds that are grown on in one pass


def balanced_weights(df: DataFrame, label: str | Column, classes: int) -> np.ndarray:
    """n / (K * n_c) per class number, K the classes that have rows."""
    counts = np.zeros(classes)
    for r in df.groupBy((F.col(label) if isinstance(label, str) else label).cast("int").alias("y")).count().collect():  # one row per class
        counts[r["y"]] = r["count"]
    return np.where(counts > 0, counts.sum() / (max(1, (counts > 0).sum()) * np.maximum(counts, 1)), 0.0)


def root_of(p: int) -> int:
    """Features tried per node of a forest."""
    return max(1, int(np.sqrt(p)))


def _specs(p: int, trees: int, max_depth: int | None, seed: int, model: int = 0) -> list[forest.TreeSpec]:
    return [forest.TreeSpec(model * trees + t, model, tuple(range(p)), seed * 1_000_003 + t, 0, True, root_of(p), max_depth or 1 << 20) for t in range(trees)]


def _forest_importance(blocks: Blocks, weights: np.ndarray, trees: int, max_depth: int | None, seed: int) -> np.ndarray:
    p = len(blocks.edges)
    specs = _specs(p, trees, max_depth, seed)
    grown, tops = forest.grow_forest(blocks, specs, {0: weights})
    return forest.importances(grown, tops, specs, p)[0]


def forest_scores(df: DataFrame, label: str, key: str, features: Sequence[str], trees: int = 300, max_depth: int | None = None, seed: int = 42) -> DataFrame:
    """Impurity importance of a class-balanced random forest; trees are grown until their leaves are pure."""
    k = class_count(df, label)
    blocks = to_blocks(df, label, key, features, k)
    found = _forest_importance(blocks, balanced_weights(df, label, k), trees, max_depth, seed)
    blocks.release()
    return scores_frame(df, found)


def boosted_scores(df: DataFrame, label: str, key: str, features: Sequence[str], importance: str = "gain", **settings: object) -> DataFrame:
    """Mean gain per split (scaled to sum 1) or split counts of second-order boosting, softmax over the classes."""
    s = boosting.Settings(**settings)
    k = max(2, class_count(df, label))
    blocks = to_blocks(df, label, key, features, k)
    model = boosting.boost(blocks, s, balanced_weights(df, label, k) if s.balanced else None)
    blocks.release()
    if importance == "split":
        return scores_frame(df, model.splits)
    mean = model.gain / np.maximum(model.splits, 1)
    return scores_frame(df, mean / mean.sum() if mean.sum() > 0 else mean)


def shadow_scores(
    df: DataFrame, label: str, key: str, features: Sequence[str], rounds: int = 20, trees: int = 150, max_depth: int | None = None, seed: int = 42
) -> DataFrame:
    """Rounds in which a feature beats the best shuffled feature, plus its mean importance.

    Every round permutes each column over the whole table. No round needs another's result: those of ``SHADOW_ROWS`` rows
    together are made and grown on in one pass. Tables too large for trees of one task take a pass per round and level.
    """
    p, k = len(features), class_count(df, label)
    weights = balanced_weights(df, label, k)
    ranked, n = ranked_rows(df, label, key, features, seed)
    edges = fit_edges(df, key, features, n)
    names = [f"{c}{i}" for c in "fs" for i in range(p)]
    found: dict[int, np.ndarray] = {}
    if n <= forest.WHOLE_ROWS:
        bins, step = max([len(e) for e in edges], default=0) + 1, max(1, SHADOW_ROWS // max(1, n))
        for first in range(0, rounds, step):
            lot = range(first, min(rounds, first + step))
            specs = [s for r in lot for s in _specs(2 * p, trees, max_depth, seed + r, r)]
            found |= forest.whole_importances(shadow_blocks(ranked, n, edges, lot, seed), specs, weights, 2 * p, bins)
    else:
        for r in range(rounds):
            blocks = to_blocks(with_shadows(ranked, n, p, r, seed), "label", "key", names, k, edges=edges * 2)
            found[r] = _forest_importance(blocks, weights, trees, max_depth, seed + r)
            blocks.release()
    hits, mean = np.zeros(p), np.zeros(p)
    for r in range(rounds):
        hits += found[r][:p] > found[r][p:].max()
        mean += found[r][:p] / rounds
    return scores_frame(df, hits + mean)
