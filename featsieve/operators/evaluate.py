"""Evaluate candidate subset x classifier combinations: cross-validation, holdout, timing."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..functions import local_table
from ..streaming import append_results, latest_results, pending_combinations
from . import forest, metrics
from .batch_logistic import Problem
from .binned import to_blocks
from .linear import assembled, logistic_input
from .linear_svm import SVMS, LinearModel
from .reports import role_tag
from .subsets import usable_candidates

BACKEND = "spark_ml"
TREE_BACKEND, SVM_BACKEND = "histogram_trees", "batch_passes"
# classifiers whose folds and feature sets are grown in shared passes, with trees and whether rows are drawn
TREES = {"dt_cpu": (1, False), "rf_cpu": (300, True)}
MAX_FOLDS = 62  # a fold is a bit of a signed 64-bit number
WARMUP_ROWS = 2048
# classifier names that mean the same operator here
ALIASES = {
    "rf_gpu": "rf_cpu", "svm_linear_gpu": "multi_margin_svm", "linear_svm_gpu": "multi_margin_svm", "mlp_gpu": "mlp",
}


def build_classifier(name: str, n_features: int, n_classes: int, n_rows: int, seed: int, options: dict | None = None):
    """An unfitted Spark ML classifier, class-balanced where it takes weights (the perceptron does not)."""
    o = dict(options or {})
    name = ALIASES.get(name, name)
    if name == "dt_cpu":
        return DecisionTreeClassifier(impurity=o.get("criterion", "gini"), maxDepth=o.get("max_depth", 30), weightCol="weight", seed=seed, maxMemoryInMB=1024)
    if name == "rf_cpu":
        return RandomForestClassifier(numTrees=o.get("trees", 300), maxDepth=o.get("max_depth", 30), weightCol="weight", seed=seed, maxMemoryInMB=1024)
    if name == "mlp":
        layers = [n_features, *o.get("hidden_layers", (256, 128)), n_classes]
        return MultilayerPerceptronClassifier(layers=layers, maxIter=o.get("max_iter", 20), seed=seed)
    raise ValueError(f"unsupported classifier: {name}")


@dataclass
class Grid:
    """Transformed development and holdout tables with their roles."""

    dataset: str
    train: DataFrame  # label, fold, one column per feature
    test: DataFrame
    label: str
    features: list[str]
    n_splits: int
    seed: int = 42
    options: dict | None = None  # classifier name -> parameters
    baselines: dict[str, str] | None = None
    key: str = "row_key"  # unique in train and in test


def _class_fold_counts(grid: Grid) -> dict[int, dict[int, int]]:
    """{class: {fold: rows}}, classes x folds numbers."""
    out: dict[int, dict[int, int]] = {}
    for r in grid.train.groupBy(F.col(grid.label).cast("int").alias("y"), "fold").count().collect():
        out.setdefault(r["y"], {})[r["fold"]] = r["count"]
    return out


def _balanced(counts: dict[int, dict[int, int]], without: int | None) -> tuple[Column, int]:
    """Weight column n / (K * n_c) of the training rows (all folds but ``without``) and their number."""
    per_class = {y: sum(n for f, n in by_fold.items() if f != without) for y, by_fold in counts.items()}
    per_class = {y: n for y, n in per_class.items() if n}
    total = sum(per_class.values())
    pairs = [F.lit(v) for y, n in per_class.items() for v in (float(y), total / (len(per_class) * n))]
    return F.element_at(F.create_map(*pairs), F.col("label")), total


def _labelled(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    rows = df.select(F.col(label).cast("double").alias("label"), *[F.col(f"`{c}`") for c in features])
    return assembled(rows, features, "label")


def _confusion_of(model, data: DataFrame) -> list[tuple[int, int, int]]:
    """K x K counts of one model's predictions."""
    pairs = model.transform(data).select(F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
    return [(r["y_true"], r["y_pred"], r["n"]) for r in metrics.confusion_counts(pairs, []).collect()]


def time_inference(model, data: DataFrame, repeats: int, warmup: int) -> list[tuple[int, float, float]]:
    """(run, seconds, ms per row) of full predictions written to nowhere, after warm-ups on a few rows."""
    n = data.count()
    head = data.limit(WARMUP_ROWS)
    for _ in range(warmup):
        model.transform(head).write.format("noop").mode("overwrite").save()
    out = []
    for run in range(1, repeats + 1):
        start = time.perf_counter()
        model.transform(data).write.format("noop").mode("overwrite").save()
        spent = time.perf_counter() - start
        out.append((run, spent, 1000.0 * spent / n if n else None))
    return out


def evaluate_combination(
    grid: Grid, counts: dict[int, dict[int, int]], features: Sequence[str], classifier: str, n_classes: int, repeats: int, warmup: int
) -> dict:
    """Fold fits, final fit, holdout confusion and timings of one subset x classifier."""
    begin = time.perf_counter()
    options = (grid.options or {}).get(classifier)

    def fitted(fold: int | None):
        rows = grid.train if fold is None else grid.train.filter(F.col("fold") != fold)
        weight, n = _balanced(counts, fold)
        model = build_classifier(classifier, len(features), n_classes, n, grid.seed + (fold or 0), options)
        return model.fit(_labelled(rows, grid.label, features).withColumn("weight", weight))

    folds = []
    for fold in range(1, grid.n_splits + 1):
        start = time.perf_counter()
        cells = _confusion_of(fitted(fold), _labelled(grid.train.filter(F.col("fold") == fold), grid.label, features))
        folds.append((fold, cells, time.perf_counter() - start))
    test = _labelled(grid.test, grid.label, features)
    start = time.perf_counter()
    final = fitted(None)
    holdout = _confusion_of(final, test)
    final_s = time.perf_counter() - start
    runs = time_inference(final, test, repeats, warmup)
    return {"folds": folds, "holdout": holdout, "final_s": final_s, "runs": runs, "elapsed": time.perf_counter() - begin}


def evaluate_trees(
    grid: Grid, counts: dict[int, dict[int, int]], combos: Sequence[Row], n_classes: int, repeats: int, warmup: int
) -> list[dict]:
    """What ``evaluate_combination`` gives, for all combinations of one tree classifier.

    The trees of all folds, final models and feature sets are grown by the same passes; a fold is a bit of a row. The
    time of a pass is shared out equally among its models. Only the final models are fetched, to time them.
    """
    classifier = ALIASES.get(combos[0]["classifier"], combos[0]["classifier"])
    options = (grid.options or {}).get(combos[0]["classifier"]) or {}
    if grid.n_splits > MAX_FOLDS:
        raise ValueError(f"at most {MAX_FOLDS} folds can be grown together, not {grid.n_splits}")
    trees, bootstrap = TREES[classifier]
    trees = options.get("trees", trees)
    fits = range(grid.n_splits + 1)  # 0: the final model, judged on the holdout
    begin = time.perf_counter()
    rows = grid.train.select("*", F.lit(True).alias("_train")).unionByName(grid.test.withColumn("fold", F.lit(0)).select("*", F.lit(False).alias("_train")), allowMissingColumns=True)
    member = F.when(F.col("_train"), sum((F.when(F.col("fold") == f, 0).otherwise(1 << f) for f in fits[1:]), F.lit(1))).otherwise(0)
    held = F.when(F.col("_train"), F.expr("shiftleft(1L, fold)")).otherwise(1)
    keyed = rows.withColumn("_key", F.concat_ws(":", F.col("_train").cast("string"), F.col(grid.key).cast("string")))
    blocks = to_blocks(keyed, grid.label, "_key", grid.features, n_classes, member, held)
    weights = {}
    for f in fits:
        n = np.asarray([sum(c for fold, c in counts.get(y, {}).items() if fold != f) for y in range(n_classes)], float)
        weights[f] = np.where(n > 0, n.sum() / (max(1, (n > 0).sum()) * np.maximum(n, 1)), 0.0)
    at = {c: i for i, c in enumerate(grid.features)}
    specs = []
    for i, combo in enumerate(combos):
        own = tuple(at[c] for c in combo["features"])
        for f in fits:
            pick = max(1, int(len(own) ** 0.5)) if classifier == "rf_cpu" else 0
            specs += [forest.TreeSpec(len(specs) + t, i * len(fits) + f, own, (grid.seed + f) * 1_000_003 + t, f, bootstrap, pick, options.get("max_depth") or 1 << 20) for t in range(trees)]
    grown, tops = forest.grow_forest(blocks, specs, weights, judge=True, keep_trees=True)
    grown = grown.persist()
    cells: dict[int, list[tuple[int, int, int]]] = {}
    for r in forest.confusions(grown, n_classes).collect():  # K x K counts per model
        cells.setdefault(r["model"], []).append((r["y_true"], r["y_pred"], r["n"]))
    share = (time.perf_counter() - begin) / max(1, len(combos) * len(fits))
    test = grid.test.select(*[F.col(f"`{c}`") for c in grid.features]).persist()
    out = []
    for i, combo in enumerate(combos):
        model = i * len(fits)
        runs = time_inference(forest.fetch_model(grown, tops, model, grid.features, blocks.edges), test, repeats, warmup)
        out.append({"folds": [(f, cells.get(model + f, []), share) for f in fits[1:]], "holdout": cells.get(model, []), "final_s": share, "runs": runs,
                    "elapsed": share * len(fits) + sum(s for _run, s, _ms in runs), "backend": TREE_BACKEND})
    grown.unpersist()
    test.unpersist()
    blocks.release()
    return out


def evaluate_svms(
    grid: Grid, counts: dict[int, dict[int, int]], combos: Sequence[Row], n_classes: int, repeats: int, warmup: int
) -> list[dict]:
    """What ``evaluate_combination`` gives, for all combinations of one linear machine, fitted in shared passes."""
    name = combos[0]["classifier"]
    options = (grid.options or {}).get(name) or {}
    fits = range(grid.n_splits + 1)  # 0: the final model, judged on the holdout
    if grid.n_splits > MAX_FOLDS:
        raise ValueError(f"at most {MAX_FOLDS} folds can be fitted together, not {grid.n_splits}")
    begin = time.perf_counter()
    kind = SVMS[ALIASES.get(name, name)]
    member = sum((F.when(F.col("fold") == f, 0).otherwise(1 << f) for f in fits[1:]), F.lit(1))
    train = logistic_input(grid.train, grid.label, grid.features, member).persist()
    test = logistic_input(grid.test, grid.label, grid.features, F.lit(0)).persist()
    batch, judge = (kind(data, n_classes, len(grid.features), options.get("C", 1.0)) for data in (train, test))
    at = {c: i for i, c in enumerate(grid.features)}
    problems = [Problem(tuple(at[c] for c in combo["features"]), f) for combo in combos for f in fits]
    weights = batch.fit(problems, **({"steps": options["max_iter"]} if "max_iter" in options else {}))
    folds, holdout = batch.confusion(problems, weights), judge.confusion(problems, weights)
    share = (time.perf_counter() - begin) / max(1, len(problems))

    def cells(m: np.ndarray) -> list[tuple[int, int, int]]:
        return [(int(y), int(p), int(m[y, p])) for y, p in zip(*np.nonzero(m))]

    rows = grid.test.select(*[F.col(f"`{c}`") for c in grid.features]).persist()
    out = []
    for i, combo in enumerate(combos):
        first = i * len(fits)
        runs = time_inference(LinearModel(list(combo["features"]), weights[first]), rows, repeats, warmup)
        out.append({"folds": [(f, cells(folds[first + f]), share) for f in fits[1:]], "holdout": cells(holdout[first]), "final_s": share, "runs": runs,
                    "elapsed": share * len(fits) + sum(s for _run, s, _ms in runs), "backend": SVM_BACKEND})
    for data in (train, test, rows):
        data.unpersist()
    return out


KEYS = ("dataset", "feature_set_id", "classifier")
_KEY = "dataset string, feature_set_id string, classifier string, "
# fold 0 is the holdout
SCHEMAS = {
    "confusion": _KEY + "fold int, y_true int, y_pred int, n bigint",
    "timings": _KEY + "method string, criterion string, timing_run int, inference_time_total_s double, "
    "inference_time_ms_per_sample double, cpu_memory_mb double, gpu_peak_memory_mb double",
    "fold_times": _KEY + "fold int, training_time_s double",
    "facts": _KEY + "method string, family string, criterion string, num_features int, selected_features string, "
    "final_training_plus_prediction_time_s double, combo_elapsed_s double, execution_backend string",
}


def evaluate_grid(
    grid: Grid, candidates: DataFrame, classifiers: Sequence[str], repeats: int = 3, warmup: int = 1, parallelism: int = 4,
    log_path: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, fold metrics, timing rows) of the candidate x classifier grid.

    Combinations of a tree classifier are fitted together in shared passes; those of other classifiers run side by side
    from a small thread pool over two cached tables. Only confusion counts and times come back; the metrics of all
    combinations are one job over them. With ``log_path`` each finished
    combination is appended to the log at once, finished ones found there are
    skipped, and the returned tables cover the whole log.
    """
    spark = grid.train.sparkSession
    known = local_table(spark, [(f,) for f in grid.features], "feature string")
    done = _read_log(spark, log_path, "facts")
    combos = pending_combinations(usable_candidates(candidates, known), classifiers, done).collect()  # one row per model to fit
    grid.train.persist(), grid.test.persist()
    counts = _class_fold_counts(grid)
    seen = grid.test.agg(F.max(F.col(grid.label).cast("int"))).head()[0]
    n_classes = max([*counts, seen or 0]) + 1

    writing = Lock()

    def evaluate(c: Row) -> dict[str, list[tuple]]:
        return logged(c, evaluate_combination(grid, counts, c["features"], c["classifier"], n_classes, repeats, warmup))

    def logged(c: Row, found: dict) -> dict[str, list[tuple]]:
        rows = _rows_of(grid.dataset, c, found)
        if not log_path:
            return rows
        with writing:  # one append at a time: commits to a folder share its staging area
            for name in ("confusion", "timings", "fold_times", "facts"):  # facts last: they mark the combination as finished
                append_results(local_table(spark, rows[name], SCHEMAS[name]).coalesce(1), f"{log_path}/{name}")
        return rows

    def together(c: Row):
        """What fits all combinations of the classifier together, if anything does."""
        name = ALIASES.get(c["classifier"], c["classifier"])
        if name in SVMS:
            return evaluate_svms
        gini = ((grid.options or {}).get(c["classifier"]) or {}).get("criterion", "gini") == "gini"
        return evaluate_trees if name in TREES and gini and grid.key in grid.train.columns else None

    parts = []
    for name in sorted({c["classifier"] for c in combos if together(c)}):
        own = [c for c in combos if c["classifier"] == name]
        parts += [logged(c, found) for c, found in zip(own, together(own[0])(grid, counts, own, n_classes, repeats, warmup))]
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        parts += list(pool.map(evaluate, [c for c in combos if not together(c)]))
    grid.train.unpersist(), grid.test.unpersist()
    tables = {}
    for name, schema in SCHEMAS.items():
        logged = _read_log(spark, log_path, name)
        fresh = local_table(spark, [r for p in parts for r in p[name]], schema)
        keys = [*KEYS, *{"confusion": ("fold", "y_true", "y_pred"), "timings": ("timing_run",), "fold_times": ("fold",)}.get(name, ())]
        tables[name] = fresh if logged is None else latest_results(logged, keys).drop("written_at")
    return result_tables(tables["confusion"], tables["timings"], tables["fold_times"], tables["facts"], n_classes, grid.baselines or {})


def _read_log(spark: SparkSession, log_path: str | None, name: str) -> DataFrame | None:
    if log_path is None:
        return None
    try:
        return spark.read.parquet(f"{log_path}/{name}")
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":  # nothing written yet
            return None
        raise


def _rows_of(dataset: str, c: Row, found: dict) -> dict[str, list[tuple]]:
    key = (dataset, c["feature_set_id"], c["classifier"])
    return {
        "confusion": [(*key, fold, *cell) for fold, cells, _s in [*found["folds"], (0, found["holdout"], 0.0)] for cell in cells],
        "timings": [(*key, c["method"], c["criterion"], run, s, ms, None, None) for run, s, ms in found["runs"]],
        "fold_times": [(*key, fold, s) for fold, _cells, s in found["folds"]],
        "facts": [(*key, c["method"], c["family"], c["criterion"], len(c["features"]), c["selected_features"], found["final_s"], found["elapsed"], found.get("backend", BACKEND))],
    }


def result_tables(
    confusion: DataFrame, timings: DataFrame, fold_times: DataFrame, facts: DataFrame, n_classes: int, baselines: dict[str, str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, fold metrics, timings) from confusion counts and times of any number of combinations."""
    keys = list(KEYS)
    each = metrics.metrics_of(confusion, [*keys, "fold"], n_classes).join(
        metrics.confusion_json(confusion, [*keys, "fold"], n_classes), [*keys, "fold"])
    about = facts.select(*keys, "method", "family", "criterion", "num_features", "execution_backend")
    folds = each.filter("fold > 0").join(about, keys).join(fold_times, [*keys, "fold"])
    results = (
        each.filter("fold = 0").drop("fold").join(facts, keys)
        .join(metrics.cv_summary(folds, keys), keys).join(metrics.timing_summary(timings, keys), keys)
    )
    return role_tag(results, baselines), folds, timings
