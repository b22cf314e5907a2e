"""Analysis from stored tables: consensus, scores, fronts, champions and all reports, from a few stored stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions import cut_lineage
from ..operators import consensus, pareto, reports, scoring


def analyze(
    rankings: DataFrame | None,
    candidates: DataFrame | None,
    evaluations: DataFrame | None,
    timings: DataFrame | None,
    scenarios: scoring.Scenarios,
    zones: pareto.Zones,
    metric_source: str = "cross_validation",
    reference_zone: str = "effectiveness",
    store: Callable[[str, DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Rebuild every result table. ``timings`` may be None; the other inputs are required.

    Tables that others build on are computed once: ``store(name, df)`` writes one
    and returns it re-read; without it they are checkpointed.
    """
    keep = store or (lambda _name, df: cut_lineage(df))
    given = {"rankings": rankings, "candidates": candidates, "evaluations": evaluations}
    missing = [k for k, v in given.items() if v is None]
    if missing:
        raise FileNotFoundError(f"missing stored tables: {missing}")
    scores = keep("consensus", consensus.consensus_scores(rankings))
    tiers = keep("tiers", consensus.consensus_tiers(scores))
    scored = keep("scored", scoring.apply_scores(evaluations, scenarios, metric_source))
    front = keep("pareto_front", pareto.pareto_front(scored))
    champs = keep("champions", pareto.champions(keep("zone_members", pareto.zone_members(front, zones))))
    tables = {
        "consensus": scores, "tiers": tiers, "core_features": consensus.core_features(tiers), "candidates": candidates,
        "scored": scored, "pareto_front": front, "champions": champs,
        "champion_features": consensus.champion_features(champs),
        "champion_stability": reports.champion_stability(champs),
        "retention_cost": reports.retention_cost(champs, reference_zone),
        "core_coverage": reports.core_coverage(champs, tiers),
        "core_membership": reports.core_membership(champs, tiers),
        "classifier_matrix": reports.classifier_matrix(champs, next(iter(scenarios)) if "equal" not in scenarios else "equal"),
    }
    if timings is not None:
        tables["timing_memory"] = reports.timing_memory(timings)
    return tables
