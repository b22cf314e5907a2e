"""Fuse rankings into consensus scores and core-feature tiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

RRF_CONSTANT = 60
TIER_NAMES = ("Core", "Important", "Marginal")


def consensus_scores(rankings: DataFrame, rrf_k: int = RRF_CONSTANT, top_k: int | None = None) -> DataFrame:
    """Frequency, mean rank, Borda and reciprocal-rank-fusion score per (dataset, feature)."""
    ok = rankings.filter("status = 'ok'")
    worst = ok.groupBy("dataset").agg(F.max("rank").alias("max_rank"))
    counted = F.count("*") if top_k is None else F.count_if(F.col("rank") <= top_k)
    sums = ok.groupBy("dataset", "feature").agg(
        counted.alias("selection_frequency"), F.count("*").alias("_n"), F.sum("rank").alias("_ranks"),
        F.avg("rank").alias("mean_rank"), F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("rrf_score"))
    borda = (F.col("_n") * (F.col("max_rank") + 1) - F.col("_ranks")).cast("double")
    return sums.join(worst, "dataset").select("dataset", "feature", "selection_frequency", "mean_rank", borda.alias("borda_score"), "rrf_score")


def require_rankings(rankings: DataFrame) -> None:
    if rankings.filter("status = 'ok'").isEmpty():
        raise ValueError("no successful feature rankings are available")


def _best_cuts(values: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """Ends of the first k - 1 groups of sorted values with least within-group squares (first best wins)."""
    centred = values - values[0]
    n, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (counts, counts * centred, counts * centred**2))

    def cost(i, j):  # values[i:j]
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / (n[j] - n[i])

    m = len(values)
    if k == 2:
        j = np.arange(1, m)
        return [int(j[np.argmin(np.round(cost(0, j) + cost(j, m), 15))])]
    best = (np.inf, 0, 0)
    for i in range(1, m - 1):
        j = np.arange(i + 1, m)
        total = np.round(cost(0, i) + cost(i, j) + cost(j, m), 15)
        at = int(np.argmin(total))
        if total[at] < best[0]:
            best = (total[at], i, int(j[at]))
    return [best[1], best[2]]


def _tiers_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Optimal split of one dataset's features (a few per column of the table) by fused score."""
    score = pdf["rrf_score"].round(12)
    values, at, counts = np.unique(score.to_numpy(), return_inverse=True, return_counts=True)
    k = min(3, len(values))
    cuts = _best_cuts(values, counts.astype(float), k) if k > 1 else []
    group = np.searchsorted(cuts, at, side="right")  # 0 = lowest scores
    tier = (k - group).astype(int)
    return pdf.assign(cluster=group.astype(int), tier=tier, tier_label=[TIER_NAMES[t - 1] for t in tier])


def consensus_tiers(consensus: DataFrame) -> DataFrame:
    """Add cluster, tier (1 = highest scores) and tier name.

    The 1-D clustering into at most three groups is solved exactly, which is the
    optimum that repeated k-means starts search for. A group holds the features
    of one dataset, so its size is the width of a table.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in consensus.schema.fields)}, cluster int, tier int, tier_label string"
    return consensus.groupBy("dataset").applyInPandas(_tiers_of, schema)


def core_features(tiers: DataFrame) -> DataFrame:
    """Tier-1 features per dataset in order of fused score."""
    order = Window.partitionBy("dataset").orderBy(F.desc(F.round("rrf_score", 12)), "feature")
    return tiers.filter("tier = 1").select("dataset", F.row_number().over(order).alias("position"), "feature", "rrf_score")


def champion_features(champions: DataFrame) -> DataFrame:
    """One row per selected feature of each champion, keyed by everything that identifies the champion."""
    parts = F.filter(F.split(F.coalesce("selected_features", F.lit("")), ";"), lambda x: x != "")
    return (
        champions.select("dataset", "classifier", "scenario", "zone", F.posexplode(parts).alias("_at", "feature"))
        .select("dataset", "classifier", "scenario", "zone", (F.col("_at") + 1).alias("position"), "feature")
    )
