"""Effectiveness and efficiency scores under weight scenarios."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import finite, local_table

GROUP = ("dataset", "classifier")
# score input -> (holdout column, cross-validation column, higher is better)
INPUTS = {
    "accuracy": ("accuracy", "cv_accuracy_mean", True),
    "precision": ("precision", "cv_precision_mean", True),
    "recall": ("recall", "cv_recall_mean", True),
    "f1": ("f1", "cv_f1_mean", True),
    "inv_far": ("macro_FAR", "cv_macro_FAR_mean", False),
    "inv_training_time": ("final_training_plus_prediction_time_s",) * 2 + (False,),
    "inv_inference_time": ("final_inference_time_ms_per_sample_mean",) * 2 + (False,),
    "inv_num_features": ("num_features",) * 2 + (False,),
}
EFFECTIVENESS = ("accuracy", "precision", "recall", "f1", "inv_far")
EFFICIENCY = ("inv_training_time", "inv_inference_time", "inv_num_features")
SOURCES = ("final_test", "cross_validation")

Scenarios = Mapping[str, Mapping[str, Mapping[str, float]]]


def scenario_table(spark: SparkSession, scenarios: Scenarios) -> DataFrame:
    """(scenario, side, metric, weight) rows of a nested weight mapping."""
    rows = [(s, side, m, float(w)) for s, sides in scenarios.items() for side, ws in sides.items() for m, w in ws.items()]
    return local_table(spark, rows, "scenario string, side string, metric string, weight double")


def weight_check(weights: DataFrame) -> DataFrame:
    """Per (scenario, side): the weight sum, the least weight, and whether they are valid."""
    out = weights.groupBy("scenario", "side").agg(F.sum("weight").alias("total"), F.min("weight").alias("least"))
    return out.withColumn("valid", (F.abs(F.col("total") - 1.0) <= 1e-9) & (F.col("least") >= 0))


def require_scenarios(scenarios: Scenarios) -> None:
    """Each side of each scenario has weights that are non-negative and sum to 1."""
    for name, sides in scenarios.items():
        for side in ("effectiveness", "efficiency"):
            ws = [float(w) for w in (sides.get(side) or {}).values()]
            if not ws:
                raise ValueError(f"scenario {name!r} has no {side} weights")
            if abs(sum(ws) - 1.0) > 1e-9:
                raise ValueError(f"{side} weights of scenario {name!r} must sum to 1.0, got {sum(ws):.12g}")
            if min(ws) < 0:
                raise ValueError(f"{side} weights of scenario {name!r} cannot be negative")


def minmax_scores(results: DataFrame, metric_source: str = "cross_validation") -> DataFrame:
    """Add the eight columns n_*: inputs scaled to [0, 1] within (dataset, classifier), cost inputs inverted.

    The group ranges are aggregated and joined back, so a large group is not
    gathered in one task.
    """
    if metric_source not in SOURCES:
        raise ValueError(f"metric_source must be one of {SOURCES}")
    source = {k: v[SOURCES.index(metric_source)] for k, v in INPUTS.items()}
    missing = [c for c in source.values() if c not in results.columns]
    if missing:
        raise ValueError(f"cannot score with metric_source={metric_source!r}; missing columns: {missing}")
    values = {k: _as_number(results, c) for k, c in source.items()}
    ends = results.groupBy(*GROUP).agg(*[a for k, v in values.items() for a in (F.min(v).alias(f"_lo_{k}"), F.max(v).alias(f"_hi_{k}"))])
    ends = ends.withColumnsRenamed({c: f"_{c}" for c in GROUP})
    same = [results[c].eqNullSafe(ends[f"_{c}"]) for c in GROUP]
    joined = results.join(ends, same)
    scaled = [_scaled(values[k], F.col(f"_lo_{k}"), F.col(f"_hi_{k}"), INPUTS[k][2]).alias(f"n_{k}") for k in INPUTS]
    return joined.select(*[results[c] for c in results.columns], F.lit(metric_source).alias("selection_metric_source"), *scaled)


def _as_number(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return finite(c.try_cast("double") if df.schema[name].dataType.simpleString() == "string" else c)


def _scaled(v: Column, lo: Column, hi: Column, higher_is_better: bool) -> Column:
    x = (v - lo) / F.nullif(hi - lo, F.lit(0.0))
    x = x if higher_is_better else 1 - x
    return F.when(lo.isNull(), 0.0).when(F.abs(hi - lo) < 1e-12, 1.0).otherwise(F.coalesce(x, F.lit(0.0)))


def _weighted(weights: Mapping[str, float], names: tuple[str, ...]) -> Column:
    total = F.lit(0.0)
    for n in names:
        total = total + F.lit(float(weights.get(n, 0.0))) * F.col(f"n_{n}")
    return F.round(total, 12)  # so that equal scores compare equal whatever the summation order


def scenario_scores(normalized: DataFrame, scenarios: Scenarios) -> DataFrame:
    """One row per (candidate, scenario) with both scores; scenarios are literals, so there is no join."""
    each = F.array(*[
        F.struct(
            F.lit(i).alias("scenario_idx"), F.lit(s).alias("scenario"),
            _weighted(w["effectiveness"], EFFECTIVENESS).alias("effectiveness_score"),
            _weighted(w["efficiency"], EFFICIENCY).alias("efficiency_score"),
        ) for i, (s, w) in enumerate(scenarios.items())
    ])
    return normalized.withColumn("_s", F.explode(each)).select(*normalized.columns, "_s.*")


def wide_scores(normalized: DataFrame, scenarios: Scenarios) -> DataFrame:
    """The same scores as two columns per scenario."""
    cols = {}
    for s, w in scenarios.items():
        cols[f"effectiveness_score__{s}"] = _weighted(w["effectiveness"], EFFECTIVENESS)
        cols[f"efficiency_score__{s}"] = _weighted(w["efficiency"], EFFICIENCY)
    return normalized.withColumns(cols)


def apply_scores(results: DataFrame, scenarios: Scenarios, metric_source: str = "cross_validation") -> DataFrame:
    require_scenarios(scenarios)
    return scenario_scores(minmax_scores(results, metric_source), scenarios)
