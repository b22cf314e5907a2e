"""Candidate subsets, metrics, consensus, scores, fronts, champions and reports.

Models are fixed arithmetic rules over the given tables, so that metrics,
scores and champions have exact SQL twins: the prediction of a candidate is the
weighted sum of its whole-number features modulo the number of classes. Times
are functions of the confusion counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F

from featsieve.functions import cut_lineage, local_table
from featsieve.operators import audit, consensus, evaluate, filters, forest, metrics, pareto, prep, reports, scoring, split, subsets
from featsieve.operators import suite
from featsieve.operators.binned import to_blocks
from featsieve.operators.linear import class_count
from featsieve.operators.trees import balanced_weights
from featsieve.plans import analyze
from featsieve.streaming import latest_results, pending_combinations

from .base import (
    EMBEDDING_FEATURES, EMBEDDINGS, EVENT_TYPES, EVENTS, LINEITEM, LINEITEM_FEATURES, ORDERS, ORDERS_FEATURES, SEED, coded, documents, embeddings,
    events, folds_sql, holdout_sql, lineitem, load, orders, rounded, share, with_,
)
from .ranking import score_sql, unpivot

# fixed values: the published weight scenarios and zones
SCENARIOS = {
    "equal": {"effectiveness": {"accuracy": 0.2, "precision": 0.2, "recall": 0.2, "f1": 0.2, "inv_far": 0.2},
              "efficiency": {"inv_training_time": 0.4, "inv_inference_time": 0.4, "inv_num_features": 0.2}},
    "detection_priority": {"effectiveness": {"accuracy": 0.1, "precision": 0.1, "recall": 0.3, "f1": 0.3, "inv_far": 0.2},
                           "efficiency": {"inv_training_time": 0.3, "inv_inference_time": 0.5, "inv_num_features": 0.2}},
    "far_priority": {"effectiveness": {"accuracy": 0.1, "precision": 0.1, "recall": 0.2, "f1": 0.2, "inv_far": 0.4},
                     "efficiency": {"inv_training_time": 0.3, "inv_inference_time": 0.5, "inv_num_features": 0.2}},
    "latency_priority": {"effectiveness": {"accuracy": 0.2, "precision": 0.2, "recall": 0.2, "f1": 0.2, "inv_far": 0.2},
                         "efficiency": {"inv_training_time": 0.2, "inv_inference_time": 0.65, "inv_num_features": 0.15}},
    "feature_compactness_priority": {"effectiveness": {"accuracy": 0.2, "precision": 0.2, "recall": 0.2, "f1": 0.2, "inv_far": 0.2},
                                     "efficiency": {"inv_training_time": 0.2, "inv_inference_time": 0.3, "inv_num_features": 0.5}},
}
ZONES = {
    "effectiveness": {"effectiveness_quantile_min": 0.67, "efficiency_quantile_min": 0.0},
    "balanced": {"effectiveness_quantile_min": 0.33, "efficiency_quantile_min": 0.33},
    "efficiency": {"effectiveness_quantile_min": 0.0, "efficiency_quantile_min": 0.67},
}
METHODS = ("pearson", "chi2", "fisher")
MIN_FEATURES = 2
KEYS = ["dataset", "feature_set_id", "classifier"]
BASELINES = {"orders": "rule_a", "events": "rule_c"}

# dataset -> (classes, whole-number features)
RULES = {
    "orders": (3, ("total", "custkey", "month", "day", "priority")),
    "events": (5, ("value", "user", "hour", "dow", "k")),
}
WEIGHTS = {"rule_a": 1, "rule_b": 3}
N_FOLDS = 5  # fold 5 is the holdout


def _orderings(features: tuple[str, ...]) -> dict[str, list[str]]:
    """Three fixed feature orders standing in for rankings."""
    f = list(features)
    return {"forward": f, "backward": f[::-1], "middle": f[2:] + f[:2]}


def _sets(dataset: str) -> list[tuple[str, str, list[str]]]:
    """(method, criterion, features) of the candidate sets of a dataset."""
    orders_ = _orderings(RULES[dataset][1])
    return [(m, c, o[:k]) for m, o in orders_.items() for c, k in (("elbow", 1), ("q25", 2), ("q50", 3), ("q75", 4))]


def _set_id(dataset: str, method: str, criterion: str, features: list[str]) -> str:
    return f"{dataset}__{method}__{criterion}__k{len(features)}"


# --- Spark -------------------------------------------------------------------------------------

def rankings(spark: SparkSession, d: str) -> DataFrame:
    """Three filter rankings of lineitem, orders and the 64 embedding columns."""
    tables = {
        "lineitem": (lineitem(spark, d), LINEITEM_FEATURES), "orders": (orders(spark, d), ORDERS_FEATURES),
        "embeddings": (embeddings(spark, d), EMBEDDING_FEATURES),
    }
    stats = {n: cut_lineage(filters.class_stats(df, "y", f)) for n, (df, f) in tables.items()}  # one scan serves the three rankers
    parts = [
        suite.ranked(filters.STATS_SCORES[m](stats[n]), f, 8).select(
            F.lit(n).alias("dataset"), F.lit(m).alias("method"), F.lit("filter").alias("family"), "rank", "feature",
            F.round("score", 8).alias("score"), F.lit("ok").alias("status"))
        for n, (_df, f) in tables.items() for m in METHODS
    ]
    return cut_lineage(audit.combine(parts))  # a row per feature and method, read several times


def subset_quantile(spark: SparkSession, d: str) -> DataFrame:
    return subsets.subset_sizes(rankings(spark, d), ("q25", "q50", "q75"), MIN_FEATURES)


def subset_elbow(spark: SparkSession, d: str) -> DataFrame:
    return subsets.subset_sizes(rankings(spark, d), ("elbow",), MIN_FEATURES)


def candidate_sets(spark: SparkSession, d: str) -> DataFrame:
    return subsets.candidate_sets(rankings(spark, d), subsets.CRITERIA, MIN_FEATURES).drop("features")


def candidate_guards(spark: SparkSession, d: str) -> DataFrame:
    """Candidate lists assembled from table texts: names outside the feature table and repeats are reported."""
    sets = load(spark, d, "part").select(
        F.concat_ws("/", "p_brand", "p_type").alias("feature_set_id"), F.array_join(F.split("p_name", " "), ";").alias("selected_features"))
    sets = sets.withColumn("selected_features", F.when(F.col("feature_set_id").startswith("Brand#1/"), "").otherwise(
        F.concat_ws(";", "selected_features", F.element_at(F.split("selected_features", ";"), 1))))
    known = load(spark, d, "part").filter("p_size > 10").select(F.explode(F.split("p_name", " ")).alias("feature")).distinct().filter("feature <> 'small'")
    return subsets.candidate_problems(sets, known)


def consensus_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(consensus.consensus_scores(rankings(spark, d)))


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus_tiers(consensus.consensus_scores(rankings(spark, d)))


def consensus_tiers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_tiers(spark, d)).select("dataset", "feature", "rrf_score", "tier", "tier_label")


def core_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(consensus.core_features(_tiers(spark, d)))


def core_exports(spark: SparkSession, d: str) -> DataFrame:
    """Core lists as one text per dataset, in core order."""
    core = consensus.core_features(_tiers(spark, d))
    ordered = F.array_sort(F.collect_list(F.struct("position", "feature")))
    return core.groupBy("dataset").agg(F.count("*").alias("num_features"), F.array_join(ordered["feature"], ";").alias("features"))


def _rule_rows(spark: SparkSession, d: str, dataset: str) -> DataFrame:
    """key, y and the whole-number features of a rule dataset, with folds."""
    whole = lambda c: F.floor(c).cast("bigint")
    if dataset == "orders":
        o = orders(spark, d)
        rows = o.select("row_key", "y", whole(F.col("o_totalprice") / 1000).alias("total"), *[whole(F.col(c)).alias(c) for c in ("custkey", "month", "day", "priority")])
    else:
        e = events(spark, d)
        rows = e.select("row_key", coded("event_type", *EVENT_TYPES).alias("y"), whole(F.col("value")).alias("value"), whole(F.col("user_id")).alias("user"),
                        F.col("hour").cast("bigint").alias("hour"), F.col("dow").cast("bigint").alias("dow"), F.col("k").cast("bigint").alias("k"))
    return split.stratified_folds(rows, "y", "row_key", N_FOLDS, SEED)


def _confusion(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Confusion counts (dataset, feature_set_id, classifier, fold, y_true, y_pred, n) of all rule models, one pass per dataset."""
    out = {}
    for dataset, (k, _f) in RULES.items():
        models = []
        for m, c, feats in _sets(dataset):
            for i, (clf, w) in enumerate(WEIGHTS.items()):
                total = F.lit(i).cast("bigint")
                for j, f in enumerate(feats):
                    total = total + F.col(f) * (1 + j * (w - 1))
                models.append(F.struct(F.lit(_set_id(dataset, m, c, feats)).alias("feature_set_id"), F.lit(clf).alias("classifier"),
                                       F.pmod(total, F.lit(k)).cast("int").alias("y_pred")))
        rows = _rule_rows(spark, d, dataset).select(F.lit(dataset).alias("dataset"), "fold", F.col("y").alias("y_true"), F.explode(F.array(*models)).alias("p"))
        out[dataset] = metrics.confusion_counts(rows.select("dataset", "fold", "y_true", "p.*"), [*KEYS, "fold"])
    return out


def _each_fold(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every model and fold (a row each), stored once because everything after builds on them."""
    counts = {n: cut_lineage(c) for n, c in _confusion(spark, d).items()}
    return cut_lineage(audit.combine([metrics.metrics_of(c, [*KEYS, "fold"], RULES[n][0]) for n, c in counts.items()]))


def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.combine(list(_confusion(spark, d).values()))


def confusion_matrices(spark: SparkSession, d: str) -> DataFrame:
    parts = [metrics.confusion_json(c.filter(F.col("fold") == N_FOLDS), KEYS, RULES[n][0]) for n, c in _confusion(spark, d).items()]
    return audit.combine(parts)


def fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_each_fold(spark, d).filter(F.col("fold") < N_FOLDS))


def holdout_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_each_fold(spark, d).filter(F.col("fold") == N_FOLDS).drop("fold"))


def cv_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.cv_summary(_each_fold(spark, d).filter(F.col("fold") < N_FOLDS), KEYS))


def _candidates(spark: SparkSession) -> DataFrame:
    rows = [(n, _set_id(n, m, c, f), m, "filter", c, len(f), ";".join(f)) for n in RULES for m, c, f in _sets(n)]
    return local_table(spark, rows, "dataset string, feature_set_id string, method string, family string, criterion string, num_features int, selected_features string")


def _timings(each: DataFrame, meta: DataFrame) -> DataFrame:
    """One timing row per fold, from the fold's counts."""
    ms = F.col("num_features") + F.col("FP_sum") / 1000.0
    return each.join(meta.select(*KEYS[:2], "num_features", "method", "criterion"), KEYS[:2]).select(
        *KEYS, "method", "criterion", F.col("fold").alias("timing_run"), ms.alias("inference_time_ms_per_sample"),
        (F.col("TP_sum") / 100.0).alias("cpu_memory_mb"), F.lit(None).cast("double").alias("gpu_peak_memory_mb"))


def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.timing_summary(_timings(_each_fold(spark, d), _candidates(spark)), KEYS))


def timing_memory(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.timing_memory(_timings(_each_fold(spark, d), _candidates(spark))))


def _evaluations(spark: SparkSession, d: str, each: DataFrame | None = None) -> DataFrame:
    """The evaluation table: holdout metrics, CV summary, timing summary, candidate facts."""
    each, meta = _each_fold(spark, d) if each is None else each, _candidates(spark)
    holdout = each.filter(F.col("fold") == N_FOLDS).drop("fold")
    folds = each.filter(F.col("fold") < N_FOLDS)
    cost = F.col("num_features") * 0.5 + F.col("TP_sum") / 1000.0
    joined = holdout.join(meta, KEYS[:2]).join(metrics.cv_summary(folds, KEYS), KEYS).join(metrics.timing_summary(_timings(each, meta), KEYS), KEYS)
    return cut_lineage(reports.role_tag(joined.withColumn("final_training_plus_prediction_time_s", cost), BASELINES))


def role_tag(spark: SparkSession, d: str) -> DataFrame:
    return _evaluations(spark, d).select(*KEYS, "experiment_role")


def combined_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Per-dataset tables with different columns, stacked."""
    each = _each_fold(spark, d)
    a = each.filter("dataset = 'orders'").select(*KEYS, "fold", "TP_sum")
    b = each.filter("dataset = 'events'").select(*KEYS, "fold", "FN_sum")
    return audit.combine([a, b])


def _logged(spark: SparkSession, d: str) -> DataFrame:
    """A result log: each fold of a model counts as one write, later folds later."""
    return _each_fold(spark, d).select(*KEYS, F.col("fold").alias("written_at"), "TP_sum", F.round("accuracy", 6).alias("accuracy"))


def latest_results_(spark: SparkSession, d: str) -> DataFrame:
    return latest_results(_logged(spark, d))


def pending_combinations_(spark: SparkSession, d: str) -> DataFrame:
    """Combinations not in the log; a model whose accuracy beats chance by a margin counts as finished."""
    chance = F.when(F.col("dataset") == "orders", 1 / 3).otherwise(1 / 5)
    log = _logged(spark, d).filter(F.col("accuracy") > chance)
    return pending_combinations(_candidates(spark), ["rule_a", "rule_b", "rule_c"], log).select(*KEYS, "method", "criterion", "num_features")


N_COLUMNS = [f"n_{k}" for k in scoring.INPUTS]


def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.minmax_scores(_evaluations(spark, d), "final_test").select(*KEYS, "selection_metric_source", *N_COLUMNS))


def _scored(spark: SparkSession, d: str, each: DataFrame | None = None) -> DataFrame:
    # rounded so that both engines compare the same numbers
    found = scoring.apply_scores(_evaluations(spark, d, each), SCENARIOS, "cross_validation")
    return cut_lineage(found.withColumns({c: F.round(c, 9) for c in ("effectiveness_score", "efficiency_score")}))


def scenario_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scored(spark, d).select(*KEYS, "scenario", "effectiveness_score", "efficiency_score"))


def scenario_columns(spark: SparkSession, d: str) -> DataFrame:
    wide = scoring.wide_scores(scoring.minmax_scores(_evaluations(spark, d), "cross_validation"), SCENARIOS)
    return rounded(wide.select(*KEYS, *[f"{s}_score__{n}" for n in SCENARIOS for s in ("effectiveness", "efficiency")]))


def scenario_weight_check(spark: SparkSession, d: str) -> DataFrame:
    """Weights taken from event shares, rounded to three digits, so that some sides no longer sum to 1."""
    side = F.when(F.col("hour") < 12, "effectiveness").otherwise("efficiency")
    n = events(spark, d).groupBy(F.col("event_type").alias("scenario"), side.alias("side"), F.col("dow").cast("string").alias("metric")).count()
    total = n.groupBy("scenario", "side").agg(F.sum("count").alias("all"))
    weights = n.join(total, ["scenario", "side"]).withColumn("weight", F.round(F.col("count") / F.col("all"), 3))
    return rounded(scoring.weight_check(weights))


def _front(spark: SparkSession, d: str, each: DataFrame | None = None) -> DataFrame:
    return cut_lineage(pareto.pareto_front(_scored(spark, d, each)))


def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_front(spark, d).select(*KEYS, "scenario", "effectiveness_score", "efficiency_score"))


def pareto_rows(spark: SparkSession, d: str) -> DataFrame:
    """The front of all line items (many exact duplicates): high discount against high quantity share, per return flag and status."""
    rows = load(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("classifier"), F.lit("rows").alias("scenario"),
        (F.col("l_discount") * 10).alias("effectiveness_score"), F.round(F.col("l_extendedprice") / 200000.0, 9).alias("efficiency_score"), "l_orderkey", "l_linenumber")
    return rounded(pareto.pareto_front(rows.withColumn("effectiveness_score", F.round("effectiveness_score", 9))))


def zone_members(spark: SparkSession, d: str) -> DataFrame:
    return pareto.zone_members(_front(spark, d), ZONES).select(*KEYS, "scenario", "zone")


def _champions(spark: SparkSession, d: str, each: DataFrame | None = None) -> DataFrame:
    return cut_lineage(pareto.champions(cut_lineage(pareto.zone_members(_front(spark, d, each), ZONES))))


def champions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_champions(spark, d).select(
        *KEYS, "scenario", "zone", "method", "criterion", "num_features", "local_utopia_distance", "local_utopia_effectiveness", "local_utopia_efficiency"))


def champion_features(spark: SparkSession, d: str) -> DataFrame:
    return consensus.champion_features(_champions(spark, d))


def champion_stability(spark: SparkSession, d: str) -> DataFrame:
    return reports.champion_stability(_champions(spark, d))


def retention_cost(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.retention_cost(_champions(spark, d)))


def _rule_tiers(spark: SparkSession, each: DataFrame) -> DataFrame:
    return cut_lineage(consensus.consensus_tiers(consensus.consensus_scores(_rule_rankings(spark, each))))


def _rule_rankings(spark: SparkSession, each: DataFrame) -> DataFrame:
    """Per rule classifier: features ranked by the true positives of the candidate sets that hold them."""
    hits = each.join(subsets.with_features(_candidates(spark)).select(*KEYS[:2], "features"), KEYS[:2])
    per = hits.withColumn("feature", F.explode("features")).groupBy("dataset", F.col("classifier").alias("method"), "feature").agg(F.sum("TP_sum").alias("score"))
    order = Window.partitionBy("dataset", "method").orderBy(F.desc("score"), "feature")  # features of one ranking
    return per.select("dataset", "method", F.lit("filter").alias("family"), F.row_number().over(order).alias("rank"), "feature",
                      F.col("score").cast("double").alias("score"), F.lit("ok").alias("status"))


def core_coverage(spark: SparkSession, d: str) -> DataFrame:
    each = _each_fold(spark, d)
    return rounded(reports.core_coverage(_champions(spark, d, each), _rule_tiers(spark, each)))


def core_membership(spark: SparkSession, d: str) -> DataFrame:
    each = _each_fold(spark, d)
    return reports.core_membership(_champions(spark, d, each), _rule_tiers(spark, each))


def classifier_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.classifier_matrix(_champions(spark, d), "equal"))


def analysis_only(spark: SparkSession, d: str) -> DataFrame:
    """All analysis tables from the stored-table form of the inputs; their sizes per table and dataset."""
    each, meta = _each_fold(spark, d), _candidates(spark)
    tables = analyze(_rule_rankings(spark, each), meta, _evaluations(spark, d, each), _timings(each, meta), SCENARIOS, ZONES, "final_test")
    names = ("consensus", "tiers", "scored", "timing_memory")
    return audit.combine([tables[n].groupBy("dataset").agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "dataset", "rows") for n in names])


def _grid(rows: DataFrame, name: str, key: str) -> evaluate.Grid:
    """Holdout and two folds of ``rows`` (key, y and features), encoded and scaled on the development part."""
    parts = split.stratified_holdout(rows, "y", key, SEED, 0.2)
    model = prep.fit(parts.filter("split = 'train'").drop("split"), "y", [key])
    train, test = (model.transform(parts.filter(f"split = '{s}'"), [key]) for s in ("train", "test"))
    return evaluate.Grid(name, split.stratified_folds(train, "label", key, 2, SEED), test, "label", list(model.features), 2, SEED, None, BASELINES, key)


def _order_grid(spark: SparkSession, d: str) -> evaluate.Grid:
    return _grid(orders(spark, d).drop("o_orderstatus"), "orders", "row_key")


def _document_grid(spark: SparkSession, d: str) -> evaluate.Grid:
    return _grid(documents(spark, d).select("doc_id", F.col("quality").alias("y"), "n_chars", "words", "digits", "lang", "source"), "documents", "doc_id")


def _model_grid(classifier: str, of=_order_grid):
    """Cross-validation and holdout of a candidate set with a fitted model at its full settings."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        grid = of(spark, d)
        sets = local_table(spark, [(grid.dataset, f"{grid.dataset}__given__all", "given", "filter", "all", ";".join(grid.features))],
                                     "dataset string, feature_set_id string, method string, family string, criterion string, selected_features string")
        results, _folds, _times = evaluate.evaluate_grid(grid, sets, [classifier], repeats=1, warmup=0)
        return results

    return run


def cv_support(spark: SparkSession, d: str) -> DataFrame:
    """Judged rows per fold and class of a decision tree grown for both folds and the holdout (fold 0) in shared passes."""
    grid = _order_grid(spark, d)
    combo = Row(classifier="dt_cpu", features=grid.features)
    counts = evaluate._class_fold_counts(grid)
    found = evaluate.evaluate_trees(grid, counts, [combo], max(counts) + 1, 0, 0)[0]
    cells = [(f, y, n) for f, own, *_ in [*found["folds"], (0, found["holdout"])] for y, _p, n in own]
    return local_table(spark, cells, "fold int, y_true int, n bigint").groupBy("fold", "y_true").agg(F.sum("n").alias("support"))


def inference_timing(spark: SparkSession, d: str) -> DataFrame:
    """Timed predictions of a fully grown tree over all orders."""
    df = orders(spark, d)
    k, p = class_count(df, "y"), len(ORDERS_FEATURES)
    blocks = to_blocks(df, "y", "row_key", ORDERS_FEATURES, k)
    grown, tops = forest.grow_forest(blocks, [forest.TreeSpec(0, 0, tuple(range(p)), SEED, 0, False)], {0: balanced_weights(df, "y", k)}, keep_trees=True)
    model = forest.fetch_model(grown, tops, 0, ORDERS_FEATURES, blocks.edges)
    blocks.release()
    rows = evaluate.time_inference(model, df, 2, 1)
    return local_table(spark, rows, "timing_run int, inference_time_total_s double, inference_time_ms_per_sample double")


QUERIES = {f.__name__.rstrip("_"): f for f in (
    subset_quantile, subset_elbow, candidate_sets, candidate_guards, consensus_scores, consensus_tiers, core_features, core_exports,
    confusion_counts, confusion_matrices, fold_metrics, holdout_metrics, cv_summary, timing_summary, timing_memory, role_tag, combined_artifacts,
    latest_results_, pending_combinations_, minmax_scores, scenario_scores, scenario_columns, scenario_weight_check, pareto_front, pareto_rows,
    zone_members, champions, champion_features, champion_stability, retention_cost, core_coverage, core_membership, classifier_matrix,
    analysis_only, inference_timing,
)}
QUERIES |= {
    "eval_tree": _model_grid("dt_cpu"), "eval_forest": _model_grid("rf_cpu", _document_grid),
    "eval_linear_svm": _model_grid("linear_svm"), "eval_multi_margin_svm": _model_grid("svm_linear_gpu"), "eval_mlp": _model_grid("mlp", _document_grid), "cv_support": cv_support,
}


# --- SQL ---------------------------------------------------------------------------------------

_SOURCES = (("lineitem", "li", LINEITEM_FEATURES), ("orders", "od", ORDERS_FEATURES), ("embeddings", "em", EMBEDDING_FEATURES))
_LONG = ",\n".join(unpivot(t, f, "y", f"lg_{t}") for _n, t, f in _SOURCES)
_RANKED = "rk AS (" + "\nUNION ALL\n".join(
    "SELECT dataset, method, family, rank, feature, score FROM (SELECT '%s' AS dataset, '%s' AS method, 'filter' AS family, "
    "CAST(row_number() OVER (ORDER BY round(score, 8) DESC, pos DESC) AS INT) AS rank, feature, round(score, 8) AS score FROM (%s))" % (n, m, score_sql(m, f"lg_{t}"))
    for n, t, _f in _SOURCES for m in METHODS) + ")"
RANKINGS = (LINEITEM, ORDERS, EMBEDDINGS, _LONG, _RANKED)

_SIZES = f"""nk AS (SELECT dataset, method, family, count(*) AS n FROM rk GROUP BY 1, 2, 3),
yy AS (SELECT *, (score - min(score) OVER g) / (max(score) OVER g - min(score) OVER g + 1e-12) AS y, count(*) OVER g AS n FROM rk
  WINDOW g AS (PARTITION BY dataset, method)),
ln AS (SELECT *, first_value(y) OVER o AS y0, last_value(y) OVER o AS y1 FROM yy
  WINDOW o AS (PARTITION BY dataset, method ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
el AS (SELECT dataset, method, rank AS elbow FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method
  ORDER BY round(abs(y - (y0 + (y1 - y0) * (rank - 1) / (n - 1))), 9) DESC, rank) AS r FROM ln) WHERE r = 1),
sz AS (""" + "\nUNION ALL\n".join(
    f"SELECT dataset, method, family, '{c}' AS criterion, CAST(least(n, greatest({MIN_FEATURES}, ceil(n * {q}))) AS INT) AS num_features FROM nk"
    for c, q in subsets.QUANTILES.items()) + f"""
UNION ALL SELECT dataset, method, family, 'elbow', CAST(CASE WHEN n <= {MIN_FEATURES} THEN n ELSE least(n, greatest({MIN_FEATURES}, elbow)) END AS INT) FROM nk JOIN el USING (dataset, method))"""


def _consensus(rk: str, p: str = "") -> str:
    """CTEs cs (scores) and ti (tiers) from a rankings relation; tiers by trying every pair of cuts."""
    return f"""{p}cs AS (SELECT dataset, feature, count(*) AS selection_frequency, avg(rank) AS mean_rank,
  CAST(count(*) * (any_value(mr) + 1) - sum(rank) AS DOUBLE) AS borda_score, sum(1.0 / (60 + rank)) AS rrf_score
  FROM {rk} JOIN (SELECT dataset, max(rank) AS mr FROM {rk} GROUP BY 1) USING (dataset) GROUP BY 1, 2),
{p}dv AS (SELECT dataset, v, count(*) AS c, row_number() OVER (PARTITION BY dataset ORDER BY v) AS i,
  count(*) OVER (PARTITION BY dataset) AS m FROM (SELECT dataset, round(rrf_score, 12) AS v FROM {p}cs) GROUP BY 1, 2),
{p}ps AS (SELECT *, sum(c) OVER w AS n, sum(c * (v - b)) OVER w AS s, sum(c * (v - b) * (v - b)) OVER w AS q
  FROM (SELECT *, min(v) OVER (PARTITION BY dataset) AS b FROM {p}dv) WINDOW w AS (PARTITION BY dataset ORDER BY i ROWS UNBOUNDED PRECEDING)),
{p}ct AS (SELECT dataset, arg_min({{'i': i, 'j': j}}, {{'t': round(t, 15), 'i': i, 'j': j}}) AS cut FROM (
  SELECT a.dataset, a.i AS i, z.i AS j, a.q - a.s * a.s / a.n + z.q - a.q - (z.s - a.s) * (z.s - a.s) / (z.n - a.n)
    + e.q - z.q - (e.s - z.s) * (e.s - z.s) / (e.n - z.n) AS t
  FROM {p}ps a JOIN {p}ps z ON a.dataset = z.dataset AND a.i < z.i AND z.i < z.m JOIN {p}ps e ON e.dataset = a.dataset AND e.i = e.m) GROUP BY 1),
{p}ti AS (SELECT cs.*, CASE WHEN d.m < 3 THEN d.m - d.i + 1 WHEN d.i > cut.j THEN 1 WHEN d.i > cut.i THEN 2 ELSE 3 END AS tier
  FROM {p}cs cs JOIN {p}dv d ON d.dataset = cs.dataset AND d.v = round(cs.rrf_score, 12) LEFT JOIN {p}ct ct ON ct.dataset = cs.dataset)"""


_TIER_LABEL = "CASE tier WHEN 1 THEN 'Core' WHEN 2 THEN 'Important' ELSE 'Marginal' END AS tier_label"

_RULE_ROWS = f"""ro AS (SELECT row_key, y, CAST(floor(o_totalprice / 1000) AS BIGINT) AS total, CAST(custkey AS BIGINT) AS custkey,
  CAST(month AS BIGINT) AS month, CAST(day AS BIGINT) AS day, CAST(priority AS BIGINT) AS priority FROM od),
re AS (SELECT row_key, CASE event_type {' '.join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(EVENT_TYPES))} END AS y, CAST(floor(value) AS BIGINT) AS value,
  CAST(user_id AS BIGINT) AS "user", CAST(hour AS BIGINT) AS hour, CAST(dow AS BIGINT) AS dow, CAST(k AS BIGINT) AS k FROM ev)"""


def _models_sql(dataset: str, folded: str) -> str:
    k = RULES[dataset][0]
    out = []
    for m, c, feats in _sets(dataset):
        for i, (clf, w) in enumerate(WEIGHTS.items()):
            total = " + ".join([str(i), *[f'"{f}" * {1 + j * (w - 1)}' for j, f in enumerate(feats)]])
            out.append(f"SELECT '{dataset}' AS dataset, '{_set_id(dataset, m, c, feats)}' AS feature_set_id, '{clf}' AS classifier, fold, y AS y_true, "
                       f"CAST((({total}) % {k} + {k}) % {k} AS INT) AS y_pred FROM {folded}")
    return "\nUNION ALL\n".join(out)


_KEYS = ", ".join(KEYS)
_N_LABELS = "CASE dataset " + " ".join(f"WHEN '{n}' THEN {k}" for n, (k, _f) in RULES.items()) + " END"
CONFUSION = (
    ORDERS, EVENTS, _RULE_ROWS, folds_sql("ro", "y", "row_key", N_FOLDS, "fo"), folds_sql("re", "y", "row_key", N_FOLDS, "fe"),
    f"cf AS (SELECT {_KEYS}, fold, y_true, y_pred, count(*) AS n FROM ({_models_sql('orders', 'fo_folds')} UNION ALL {_models_sql('events', 'fe_folds')}) GROUP BY ALL)",
)
FOLDS = (*CONFUSION, f"""lb AS (SELECT {_KEYS}, fold, unnest(range({_N_LABELS})) AS c FROM (SELECT DISTINCT {_KEYS}, fold FROM cf)),
pc AS (SELECT {_KEYS}, fold, c, coalesce(sum(n) FILTER (WHERE y_true = c AND y_pred = c), 0) AS tp, coalesce(sum(n) FILTER (WHERE y_true <> c AND y_pred = c), 0) AS fp,
  coalesce(sum(n) FILTER (WHERE y_true = c AND y_pred <> c), 0) AS fn, coalesce(sum(n) FILTER (WHERE y_true <> c AND y_pred <> c), 0) AS tn
  FROM lb JOIN cf USING ({_KEYS}, fold) GROUP BY ALL),
rt AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rec, coalesce(tp / nullif(tp + fp, 0), 0.0) AS pre, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1c,
  coalesce(fp / nullif(fp + tn, 0), 0.0) AS far, coalesce(tn / nullif(fp + tn, 0), 0.0) AS spe, (tp + fn) / (tp + fp + fn + tn) AS w FROM pc),
mt AS (SELECT {_KEYS}, fold, sum(tp) / any_value(tp + fp + fn + tn) AS accuracy, sum(w * pre) AS precision, sum(w * rec) AS recall, sum(w * f1c) AS f1,
  avg(rec) AS macro_DR, avg(far) AS macro_FAR, avg((rec + spe) / 2) AS macro_BCI, CAST(sum(tp) AS BIGINT) AS TP_sum, CAST(sum(fp) AS BIGINT) AS FP_sum,
  CAST(sum(tn) AS BIGINT) AS TN_sum, CAST(sum(fn) AS BIGINT) AS FN_sum FROM rt GROUP BY ALL)""")
_M7 = metrics.CV_METRICS
_SUMS = "TP_sum, FP_sum, TN_sum, FN_sum"
_META = "me AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{_set_id(n, m, c, f)}', '{m}', '{c}', {len(f)}, '{';'.join(f)}')" for n in RULES for m, c, f in _sets(n)
) + ") t(dataset, feature_set_id, method, criterion, num_features, selected_features))"
EVALUATIONS = (*FOLDS, _META, f"""cv AS (SELECT {_KEYS}, {', '.join(f'avg({m}) AS cv_{m}_mean, stddev_samp({m}) AS cv_{m}_std' for m in _M7)} FROM mt WHERE fold < {N_FOLDS} GROUP BY ALL),
tm AS (SELECT {_KEYS}, method, criterion, fold, num_features + FP_sum / 1000.0 AS ms, TP_sum / 100.0 AS mem FROM mt JOIN me USING (dataset, feature_set_id)),
ts AS (SELECT {_KEYS}, avg(ms) AS t_mean, stddev_samp(ms) AS t_std, min(ms) AS t_min, max(ms) AS t_max FROM tm GROUP BY ALL),
evl AS (SELECT mt.* EXCLUDE (fold), method, criterion, CAST(num_features AS INT) AS num_features, selected_features, cv.* EXCLUDE ({_KEYS}), t_mean,
  num_features * 0.5 + TP_sum / 1000.0 AS train_s, CASE WHEN {' OR '.join(f"(dataset = '{a}' AND classifier = '{b}')" for a, b in BASELINES.items())} THEN 'original_baseline' ELSE 'controlled_classifier_matrix' END AS experiment_role
  FROM mt JOIN me USING (dataset, feature_set_id) JOIN cv USING ({_KEYS}) JOIN ts USING ({_KEYS}) WHERE fold = {N_FOLDS})""")


def _minmax_cte(source: int, name: str) -> str:
    cols = {"final_training_plus_prediction_time_s": "train_s", "final_inference_time_ms_per_sample_mean": "t_mean"}
    parts = []
    for k, v in scoring.INPUTS.items():
        c = cols.get(v[source], v[source])
        x = f"({c} - min({c}) OVER g) / nullif(max({c}) OVER g - min({c}) OVER g, 0)"
        parts.append(f"CASE WHEN max({c}) OVER g - min({c}) OVER g < 1e-12 THEN 1.0 ELSE {x if v[2] else '1 - ' + x} END AS n_{k}")
    return f"{name} AS (SELECT *, {', '.join(parts)} FROM evl WINDOW g AS (PARTITION BY dataset, classifier))"


def _score(ws: dict[str, float]) -> str:
    return "round(" + " + ".join(["0.0", *[f"{w} * n_{m}" for m, w in ws.items()]]) + ", 9)"


SCORED = (*EVALUATIONS, _minmax_cte(1, "nm"), "sco AS (" + "\nUNION ALL\n".join(
    f"SELECT *, {i} AS scenario_idx, '{s}' AS scenario, {_score(w['effectiveness'])} AS eff, {_score(w['efficiency'])} AS efs FROM nm" for i, (s, w) in enumerate(SCENARIOS.items())) + ")")
_G = "dataset, classifier, scenario"


def _front_cte(src: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM {src} a WHERE NOT EXISTS (SELECT 1 FROM {src} b WHERE b.dataset = a.dataset AND b.classifier = a.classifier AND b.scenario = a.scenario
  AND b.eff >= a.eff AND b.efs >= a.efs AND (b.eff > a.eff OR b.efs > a.efs)))"""


FRONT = (*SCORED, _front_cte("sco", "fr"))
MEMBERS = (*FRONT, "zo AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{z}', {c['effectiveness_quantile_min']}, {c['efficiency_quantile_min']})" for i, (z, c) in enumerate(ZONES.items())) + ") t(zone_idx, zone, qe, qs))",
    f"""th AS (SELECT {_G}, """ + ", ".join(f"round(quantile_cont(eff, {c['effectiveness_quantile_min']}), 12) AS e{i}, round(quantile_cont(efs, {c['efficiency_quantile_min']}), 12) AS s{i}"
                                             for i, c in enumerate(ZONES.values())) + f""" FROM fr GROUP BY ALL),
tg AS (SELECT fr.*, zone, CASE zone_idx {' '.join(f'WHEN {i} THEN eff >= e{i} AND efs >= s{i}' for i in range(len(ZONES)))} END AS inside FROM fr JOIN th USING ({_G}), zo),
mb AS (SELECT * FROM (SELECT *, bool_or(inside) OVER (PARTITION BY {_G}, zone) AS filled FROM tg) WHERE inside OR NOT filled)""")
CHAMPIONS = (*MEMBERS, f"""ut AS (SELECT *, max(eff) OVER z AS ue, max(efs) OVER z AS us FROM mb WINDOW z AS (PARTITION BY {_G}, zone)),
di AS (SELECT *, round(sqrt((ue - eff) * (ue - eff) + (us - efs) * (us - efs)), 12) AS dist FROM ut),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_G}, zone ORDER BY dist, feature_set_id) AS r FROM di) WHERE r = 1)""")
RULE_RANKINGS = f"""fx AS (SELECT {_KEYS}, unnest(string_split(selected_features, ';')) AS feature, TP_sum FROM mt JOIN me USING (dataset, feature_set_id)),
rr AS (SELECT dataset, method, feature, CAST(row_number() OVER (PARTITION BY dataset, method ORDER BY score DESC, feature) AS INT) AS rank
  FROM (SELECT dataset, classifier AS method, feature, sum(TP_sum) AS score FROM fx GROUP BY ALL))"""
CORE = (*CHAMPIONS, RULE_RANKINGS, _consensus("rr", "r"), """co AS (SELECT dataset, list(feature) AS core FROM rti WHERE tier = 1 GROUP BY 1),
cc AS (SELECT ch.*, coalesce(core, []) AS core, string_split(selected_features, ';') AS sel FROM ch LEFT JOIN co USING (dataset))""")


def _round_all(names: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_LOG = f"lo AS (SELECT {_KEYS}, fold AS written_at, TP_sum, round(accuracy, 6) AS accuracy FROM mt)"
_T = "inference_time_ms_per_sample"

SQL = {
    "cv_support": with_(ORDERS, holdout_sql("od", "y", "row_key", share("od", 0.2)), "tr AS (SELECT row_key, y FROM h_split WHERE split = 'train')", folds_sql("tr", "y", "row_key", 2, "cv"),
        select="""SELECT fold, CAST(y AS INT) AS y_true, count(*) AS support FROM cv_folds GROUP BY 1, 2
UNION ALL SELECT 0, CAST(y AS INT), count(*) FROM h_split WHERE split = 'test' GROUP BY 2"""),
    "subset_quantile": with_(*RANKINGS, _SIZES, select="SELECT * FROM sz WHERE criterion <> 'elbow'"),
    "subset_elbow": with_(*RANKINGS, _SIZES, select="SELECT * FROM sz WHERE criterion = 'elbow'"),
    "candidate_sets": with_(*RANKINGS, _SIZES, select="""SELECT dataset, method, family, criterion, concat_ws('__', dataset, method, criterion, 'k' || num_features) AS feature_set_id,
num_features, string_agg(feature, ';' ORDER BY rank) AS selected_features FROM sz JOIN rk USING (dataset, method, family) WHERE rank <= num_features GROUP BY ALL"""),
    "candidate_guards": with_("""cs AS (SELECT DISTINCT concat_ws('/', p_brand, p_type) AS feature_set_id, CASE WHEN p_brand = 'Brand#1' THEN [] ELSE
  list_append(string_split(p_name, ' '), string_split(p_name, ' ')[1]) END AS f FROM part)""",
        "kn AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS feature FROM part WHERE p_size > 10)", "ex AS (SELECT feature_set_id, unnest(f) AS feature FROM cs)",
        select="""SELECT DISTINCT feature_set_id, 'unknown' AS problem, feature FROM ex WHERE feature NOT IN (SELECT feature FROM kn WHERE feature <> 'small')
UNION ALL SELECT feature_set_id, 'duplicate', feature FROM ex GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT feature_set_id, 'empty', '' FROM cs WHERE len(f) = 0"""),
    "consensus_scores": with_(*RANKINGS, _consensus("rk"), select=f"SELECT dataset, feature, selection_frequency, {_round_all(['mean_rank', 'borda_score', 'rrf_score'])} FROM cs"),
    "consensus_tiers": with_(*RANKINGS, _consensus("rk"), select=f"SELECT dataset, feature, round(rrf_score, 6) AS rrf_score, CAST(tier AS INT) AS tier, {_TIER_LABEL} FROM ti"),
    "core_features": with_(*RANKINGS, _consensus("rk"), select="SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY round(rrf_score, 12) DESC, feature) AS INT) AS position, feature, round(rrf_score, 6) AS rrf_score FROM ti WHERE tier = 1"),
    "core_exports": with_(*RANKINGS, _consensus("rk"), select="SELECT dataset, count(*) AS num_features, string_agg(feature, ';' ORDER BY round(rrf_score, 12) DESC, feature) AS features FROM ti WHERE tier = 1 GROUP BY 1"),
    "confusion_counts": with_(*CONFUSION, select="SELECT * FROM cf"),
    "confusion_matrices": with_(*CONFUSION, f"""ce AS (SELECT k.*, i, j, coalesce(n, 0) AS n FROM (SELECT *, unnest(range({_N_LABELS})) AS j FROM (SELECT *, unnest(range({_N_LABELS})) AS i FROM
  (SELECT DISTINCT {_KEYS} FROM cf))) k LEFT JOIN (SELECT * FROM cf WHERE fold = {N_FOLDS}) c ON {' AND '.join(f'c.{x} = k.{x}' for x in KEYS)} AND y_true = i AND y_pred = j)""",
        select=f"""SELECT {_KEYS}, '[' || string_agg(line, ',' ORDER BY i) || ']' AS confusion_matrix_json, '[' || string_agg(i, ',' ORDER BY i) || ']' AS encoded_labels_json
FROM (SELECT {_KEYS}, i, '[' || string_agg(n, ',' ORDER BY j) || ']' AS line FROM ce GROUP BY ALL) GROUP BY ALL"""),
    "fold_metrics": with_(*FOLDS, select=f"SELECT {_KEYS}, fold, {_round_all(_M7)}, {_SUMS} FROM mt WHERE fold < {N_FOLDS}"),
    "holdout_metrics": with_(*FOLDS, select=f"SELECT {_KEYS}, {_round_all(_M7)}, {_SUMS} FROM mt WHERE fold = {N_FOLDS}"),
    "cv_summary": with_(*EVALUATIONS, select=f"SELECT {_KEYS}, {_round_all([f'cv_{m}_{s}' for m in _M7 for s in ('mean', 'std')])} FROM cv"),
    "timing_summary": with_(*EVALUATIONS, select=f"SELECT {_KEYS}, " + ", ".join(f"round(t_{s}, 6) AS final_{_T}_{s}" for s in ("mean", "std", "min", "max")) + " FROM ts"),
    "timing_memory": with_(*EVALUATIONS, select=f"SELECT {_KEYS}, round(avg(ms), 6) AS {_T}_mean, round(stddev_samp(ms), 6) AS {_T}_std, round(avg(mem), 6) AS cpu_memory_mb_mean, CAST(NULL AS DOUBLE) AS gpu_peak_memory_mb_max FROM tm GROUP BY ALL"),
    "role_tag": with_(*EVALUATIONS, select=f"SELECT {_KEYS}, experiment_role FROM evl"),
    "combined_artifacts": with_(*FOLDS, select=f"SELECT {_KEYS}, fold, CASE WHEN dataset = 'orders' THEN TP_sum END AS TP_sum, CASE WHEN dataset = 'events' THEN FN_sum END AS FN_sum FROM mt"),
    "latest_results": with_(*FOLDS, _LOG, select=f"SELECT * FROM lo WHERE written_at = {N_FOLDS}"),
    "pending_combinations": with_(*FOLDS, _META, _LOG, "al AS (SELECT me.*, classifier FROM me, (VALUES ('rule_a'), ('rule_b'), ('rule_c')) c(classifier))",
        select=f"""SELECT {_KEYS}, method, criterion, CAST(num_features AS INT) AS num_features FROM al ANTI JOIN
(SELECT * FROM lo WHERE accuracy > CASE WHEN dataset = 'orders' THEN 1 / 3 ELSE 1 / 5 END) USING ({_KEYS})"""),
    "minmax_scores": with_(*EVALUATIONS, _minmax_cte(0, "nm"), select=f"SELECT {_KEYS}, 'final_test' AS selection_metric_source, {_round_all(N_COLUMNS)} FROM nm"),
    "scenario_scores": with_(*SCORED, select=f"SELECT {_KEYS}, scenario, round(eff, 6) AS effectiveness_score, round(efs, 6) AS efficiency_score FROM sco"),
    "scenario_columns": with_(*SCORED, select=f"SELECT {_KEYS}, " + ", ".join(
        f"round({_score(SCENARIOS[n][s])}, 6) AS {s}_score__{n}" for n in SCENARIOS for s in ("effectiveness", "efficiency")) + " FROM nm"),
    "scenario_weight_check": with_(EVENTS, """wt AS (SELECT event_type AS scenario, CASE WHEN hour < 12 THEN 'effectiveness' ELSE 'efficiency' END AS side, dow, count(*) AS c FROM ev GROUP BY ALL),
ws AS (SELECT scenario, side, round(c / sum(c) OVER (PARTITION BY scenario, side), 3) AS weight FROM wt)""",
        select="SELECT scenario, side, round(sum(weight), 6) AS total, round(min(weight), 6) AS least, abs(sum(weight) - 1) <= 1e-9 AND min(weight) >= 0 AS valid FROM ws GROUP BY 1, 2"),
    "pareto_front": with_(*FRONT, select=f"SELECT {_KEYS}, scenario, round(eff, 6) AS effectiveness_score, round(efs, 6) AS efficiency_score FROM fr"),
    "pareto_rows": with_("""rw AS (SELECT l_returnflag AS dataset, l_linestatus AS classifier, 'rows' AS scenario, round(l_discount * 10, 9) AS eff, round(l_extendedprice / 200000.0, 9) AS efs, l_orderkey, l_linenumber FROM lineitem)""",
        """tp AS (SELECT dataset, classifier, scenario, eff, max(efs) AS efs FROM rw GROUP BY ALL)""", _front_cte("tp", "fr"),
        select="SELECT rw.dataset, rw.classifier, rw.scenario, round(eff, 6) AS effectiveness_score, round(efs, 6) AS efficiency_score, l_orderkey, l_linenumber FROM rw JOIN fr USING (dataset, classifier, scenario, eff, efs)"),
    "zone_members": with_(*MEMBERS, select=f"SELECT {_KEYS}, scenario, zone FROM mb"),
    "champions": with_(*CHAMPIONS, select=f"SELECT {_KEYS}, scenario, zone, method, criterion, num_features, round(dist, 6) AS local_utopia_distance, round(ue, 6) AS local_utopia_effectiveness, round(us, 6) AS local_utopia_efficiency FROM ch"),
    "champion_features": with_(*CHAMPIONS, select="SELECT dataset, classifier, scenario, zone, CAST(p AS INT) AS position, string_split(selected_features, ';')[p] AS feature FROM (SELECT *, unnest(range(1, len(string_split(selected_features, ';')) + 1)) AS p FROM ch)"),
    "champion_stability": with_(*CHAMPIONS, select="""SELECT dataset, classifier, zone, count(*) AS num_scenarios, count(DISTINCT feature_set_id) AS num_unique_feature_sets, count(DISTINCT method) AS num_unique_methods,
count(DISTINCT feature_set_id) = 1 AS stable_same_feature_set_across_scenarios, string_agg(feature_set_id, ';' ORDER BY scenario_idx) AS feature_sets_by_scenario,
string_agg(method, ';' ORDER BY scenario_idx) AS methods_by_scenario FROM ch GROUP BY 1, 2, 3"""),
    "retention_cost": with_(*CHAMPIONS, select="""SELECT c.dataset, c.classifier, c.scenario, c.zone, 'effectiveness' AS reference_zone, round(c.accuracy / nullif(r.accuracy, 0), 6) AS accuracy_retention_vs_reference,
round(c.f1 / nullif(r.f1, 0), 6) AS f1_retention_vs_reference, round(r.train_s / nullif(c.train_s, 0), 6) AS training_time_reduction_factor, round(r.t_mean / nullif(c.t_mean, 0), 6) AS inference_time_reduction_factor,
round(r.num_features / nullif(c.num_features, 0), 6) AS feature_reduction_factor FROM ch c JOIN ch r ON c.dataset = r.dataset AND c.classifier = r.classifier AND c.scenario = r.scenario AND r.zone = 'effectiveness'"""),
    "core_coverage": with_(*CORE, select="""SELECT dataset, scenario, zone, method, criterion, classifier, CAST(len(core) AS INT) AS num_core_features, CAST(len(sel) AS INT) AS num_selected_features,
CAST(len(list_intersect(sel, core)) AS INT) AS num_intersection, round(coalesce(len(list_intersect(sel, core)) / nullif(len(core), 0), 0.0), 6) AS core_coverage_recall,
round(coalesce(len(list_intersect(sel, core)) / nullif(len(sel), 0), 0.0), 6) AS core_purity_alignment FROM cc"""),
    "core_membership": with_(*CORE, select="""SELECT dataset, classifier, scenario, zone, feature, list_contains(core, feature) AS in_core, list_contains(sel, feature) AS in_selected,
list_contains(core, feature) AND list_contains(sel, feature) AS in_intersection FROM (SELECT *, unnest(list_distinct(list_concat(sel, core))) AS feature FROM cc)"""),
    "classifier_matrix": with_(*CHAMPIONS, select=f"""SELECT dataset, classifier, experiment_role, zone, method, criterion, num_features, {_round_all(['accuracy', 'precision', 'recall', 'f1', 'macro_FAR'])},
round(train_s, 6) AS final_training_plus_prediction_time_s, round(t_mean, 6) AS final_inference_time_ms_per_sample_mean, feature_set_id FROM ch WHERE scenario = 'equal'"""),
    "analysis_only": with_(*EVALUATIONS, RULE_RANKINGS, select=f"""SELECT 'consensus' AS table_name, dataset, count(DISTINCT feature) AS rows FROM rr GROUP BY 2
UNION ALL SELECT 'tiers', dataset, count(DISTINCT feature) FROM rr GROUP BY 2 UNION ALL SELECT 'scored', dataset, count(*) * {len(SCENARIOS)} FROM evl GROUP BY 2
UNION ALL SELECT 'timing_memory', dataset, count(*) FROM ts GROUP BY 2"""),
}
