"""Run several rankers on one table and collect the rankings table."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import local_table
from . import filters, linear, mrmr, mutual_info, relief, search, trees
from .split import stratified_sample

MAX_FIT_ROWS = 100_000
RANKING_SCHEMA = (
    "dataset string, method string, family string, rank int, feature string, score double, "
    "runtime_seconds double, params_json string, status string, error string"
)


@dataclass
class FitContext:
    """A transformed table and what the rankers share about it (statistics and MI are computed once).

    ``df`` holds all rows; ``fit_df`` those that model-based rankers are fitted on (all by default).
    """

    df: DataFrame
    label: str
    key: str
    features: list[str]
    seed: int = 42
    options: dict = field(default_factory=dict)
    fit_df: DataFrame | None = None
    _stats: DataFrame | None = None
    _mi: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.fit_df is None:
            self.fit_df = self.df

    def release(self) -> None:
        if self._stats is not None:
            self._stats.unpersist()
            self._stats = None

    def stats(self) -> DataFrame:
        if self._stats is None:
            self._stats = filters.class_stats(self.df, self.label, self.features).persist()
        return self._stats

    def mutual_info(self) -> DataFrame:
        if self._mi is None:
            scores = mutual_info.knn_scores(self.df, self.label, self.key, self.features, seed=self.seed)
            # one number per feature
            self._mi = local_table(self.df.sparkSession, scores.collect(), scores.schema)
        return self._mi

    def only(self, features: Sequence[str]) -> FitContext:
        return FitContext(self.df, self.label, self.key, list(features), self.seed, self.options, self.fit_df)


@dataclass
class Ranker:
    family: str
    score: Callable[[FitContext], DataFrame]  # -> (pos, score)
    params: dict = field(default_factory=dict)


def _number_after_c(method: str) -> float:
    text = method.rsplit("_c", 1)
    return float(text[1]) if len(text) == 2 else 1.0


# second stage -> shadow rounds differ from the stand-alone ranker
HYBRIDS = {
    "mi_rfe": ("mutual_info", "rfe", {}),
    "mi_ga": ("mutual_info", "ga", {}),
    "chi2_boruta": ("chi2", "boruta", {"boruta_rounds": 15}),
    "chi2_xgboost": ("chi2", "xgboost", {}),
    "fisher_lightgbm": ("fisher", "lightgbm", {}),
}


def ranker(method: str) -> Ranker:
    """Look a ranker up by name, case-insensitively. Register more with ``RANKERS[name] = Ranker(...)``."""
    name = method.lower()
    if name in RANKERS:
        return RANKERS[name]
    if name.startswith("lasso"):
        c = _number_after_c(name)
        return Ranker("embedded", lambda x: linear.logistic_scores(x.fit_df, x.label, x.features, c, 1.0), {"penalty": "l1", "C": c})
    if name.startswith("elasticnet"):
        c = _number_after_c(name)
        return Ranker("embedded", lambda x: linear.logistic_scores(x.fit_df, x.label, x.features, c, 0.5), {"penalty": "elasticnet", "C": c, "l1_ratio": 0.5})
    if name in HYBRIDS:
        first, second, options = HYBRIDS[name]
        return Ranker("hybrid", lambda x: _hybrid_scores(x, first, second, options), {"prefilter": name.split("_")[0], "pool_ratio": 0.5})
    raise ValueError(f"no ranker is called {method}")


# fixed values: neighbours, and the rows the operator compares at most
RELIEF = {"neighbors": 10, "max_rows": 5000}

RANKERS: dict[str, Ranker] = {
    "pearson": Ranker("filter", lambda x: filters.pearson_scores(x.stats())),
    "chi2": Ranker("filter", lambda x: filters.chi2_scores(x.stats())),
    "fisher": Ranker("filter", lambda x: filters.fisher_scores(x.stats())),
    "mutual_info": Ranker("filter", lambda x: x.mutual_info()),
    "mutual_info_binned": Ranker("filter", lambda x: mutual_info.binned_scores(x.df, x.label, x.features)),
    "relieff": Ranker("filter", lambda x: relief.relief_scores(x.df, x.label, x.key, x.features, seed=x.seed, **{**RELIEF, **_opts(x, "relieff")}), {"n_neighbors": RELIEF["neighbors"], "max_rows": RELIEF["max_rows"]}),
    "mrmr": Ranker("filter", lambda x: mrmr.mrmr_scores(x.df, x.features, x.mutual_info())),
    "rf": Ranker("embedded", lambda x: trees.forest_scores(x.fit_df, x.label, x.key, x.features, seed=x.seed, **_opts(x, "rf"))),
    "gbt": Ranker("embedded", lambda x: trees.boosted_scores(x.fit_df, x.label, x.key, x.features, seed=x.seed, **_opts(x, "gbt"))),
    "xgboost": Ranker("embedded", lambda x: trees.boosted_scores(x.fit_df, x.label, x.key, x.features, seed=x.seed, **_opts(x, "gbt")), {"model": "histogram_boosting"}),
    "lightgbm": Ranker("embedded", lambda x: trees.boosted_scores(x.fit_df, x.label, x.key, x.features, seed=x.seed, **{**trees.BALANCED_BOOSTING, **_opts(x, "gbt")}), {"model": "histogram_boosting", "importance": "split"}),
    "rfe": Ranker("wrapper", lambda x: linear.elimination_scores(x.fit_df, x.label, x.key, x.features, seed=x.seed)),
    "rfecv": Ranker("wrapper", lambda x: linear.elimination_scores(x.fit_df, x.label, x.key, x.features, seed=x.seed, folds=3)),
    "boruta": Ranker("wrapper", lambda x: trees.shadow_scores(x.fit_df, x.label, x.key, x.features, seed=x.seed, **_opts(x, "boruta"))),
    "ga": Ranker("metaheuristic", lambda x: search.genetic_scores(x.fit_df, x.label, x.key, x.features, x.mutual_info(), seed=x.seed, **_opts(x, "ga"))),
    "pso": Ranker("metaheuristic", lambda x: search.swarm_scores(x.fit_df, x.label, x.key, x.features, x.mutual_info(), seed=x.seed, **_opts(x, "pso"))),
}


def _opts(x: FitContext, name: str) -> dict:
    return x.options.get(name, {})


def _hybrid_scores(x: FitContext, first: str, second: str, options: dict) -> DataFrame:
    """Keep the better half (at least 3) by the first ranker, score it by the second; the rest follows in column order."""
    base = sorted(((r["score"], r["pos"]) for r in _clean(RANKERS[first].score(x)).collect()), reverse=True)
    pool = [pos for _s, pos in base[: max(3, min(len(base), -(-len(base) // 2)))]]
    inner = x.only([x.features[p] for p in pool])
    if "boruta_rounds" in options:
        inner.options = {**x.options, "boruta": {"rounds": options["boruta_rounds"], **_opts(x, "boruta")}}
    found = {r["pos"]: r["score"] for r in _clean(RANKERS[second].score(inner)).collect()}
    inner.release()
    ranked = sorted(((found.get(i, 0.0), i) for i in range(len(pool))), reverse=True)
    rows = [(pool[i], float(s)) for s, i in ranked] + [(p, 0.0) for p in range(len(x.features)) if p not in pool]
    return local_table(x.df.sparkSession, [(p, s, step) for step, (p, s) in enumerate(rows, 1)], "pos int, score double, step int")


def _clean(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    return scores.withColumn("score", F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), 0.0).otherwise(s))


def ranked(scores: DataFrame, features: Sequence[str], digits: int | None = None) -> DataFrame:
    """(rank, feature, score): best score first, ties to the later column; a given ``step`` order is kept."""
    spark = scores.sparkSession
    names = local_table(spark, list(enumerate(features)), "pos int, feature string")  # one row per column
    scores = _clean(scores)
    by: list[Column] = [F.asc("step")] if "step" in scores.columns else [
        F.desc(F.round("score", digits) if digits is not None else F.col("score")), F.desc("pos")]
    return scores.join(F.broadcast(names), "pos").select(F.row_number().over(Window.orderBy(*by)).alias("rank"), "feature", "score")


def rank_features(x: FitContext, method: str, digits: int | None = None) -> DataFrame:
    return ranked(ranker(method).score(x), x.features, digits)


def run_suite(
    dataset: str, df: DataFrame, label: str, key: str, features: Sequence[str], methods: Sequence[str],
    max_fit_rows: int = MAX_FIT_ROWS, seed: int = 42, options: dict | None = None,
) -> DataFrame:
    """Rankings of all methods; a method that fails gives one 'failed' row.

    Filters read all rows. Rankers that fit models see a stratified sample of at most ``max_fit_rows`` rows; the number
    used is in ``params_json``. What reaches the driver is one score per feature and method.
    """
    whole = df.select(key, label, *features).persist()
    sample = stratified_sample(whole, label, key, max_fit_rows, seed)
    sampled = sample is not whole
    if sampled:
        sample = sample.persist()
    fit_rows = sample.count()
    x = FitContext(whole, label, key, list(features), seed, options or {}, sample)
    rows = []
    for method in methods:
        start = time.perf_counter()
        try:
            r = ranker(method)
            found = rank_features(x, method).collect()
            spent = time.perf_counter() - start
            params = json.dumps({"seed": seed, **r.params, **({} if r.family == "filter" else {"fit_rows": fit_rows})})
            rows += [(dataset, method, r.family, f["rank"], f["feature"], f["score"], spent, params, "ok", "") for f in found]
        except Exception as exc:  # a failing ranker must not stop the others
            rows.append((dataset, method, "unknown", None, "", None, None, "{}", "failed", str(exc)))
    x.release()
    if sampled:
        sample.unpersist()
    whole.unpersist()
    return local_table(df.sparkSession, rows, RANKING_SCHEMA)
