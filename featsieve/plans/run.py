"""The full study on one or more datasets: load to reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import local_table, require_unique, with_row_key
from ..operators import audit, prep, split, subsets, suite, target
from ..operators.consensus import require_rankings
from ..operators.evaluate import Grid, evaluate_grid
from ..sources import Dataset, changed_since, evidence_catalog, load_dataset, loader_metadata, write_exports, write_table
from .analyze import analyze

EVIDENCE = ("audit", "classifier_matrix", "core_coverage", "retention_cost", "timing_memory", "champion_stability", "champions")


def read_stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None where nothing was written yet; any other read error is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def suite_columns() -> list[str]:
    return T.StructType.fromDDL(suite.RANKING_SCHEMA).names


def require_unchanged(current: DataFrame, stored: DataFrame | None) -> None:
    """Stored results may only be continued on the data they were made from."""
    if stored is None:
        return
    other = changed_since(stored, current).limit(1).collect()
    if other:
        raise ValueError(f"the files of {other[0]['dataset']!r} changed since the stored run; use another folder or remove the old results")


def study_dataset(spark: SparkSession, ds: Dataset, spec: Mapping, plan: Mapping, root: str | None = None) -> dict[str, DataFrame]:
    """Audit, split, fit, rank, cut and evaluate one dataset.

    ``plan`` keys: methods, classifiers, and optionally criteria, min_features,
    max_rows, max_fit_rows (model-based rankers only), n_splits, test_size, seed, repeats, warmup,
    ranker_options, classifier_options, baselines.
    """
    seed, k = int(plan.get("seed", 42)), int(plan.get("n_splits", 10))
    key = "row_key"
    metadata = loader_metadata(ds)
    if root:
        require_unchanged(metadata, read_stored(spark, f"{root}/loader_metadata"))
    if spec.get("row_key_column"):
        require_unique(ds.df, spec["row_key_column"])
    df = with_row_key(ds.df, spec.get("row_key_column"))
    if plan.get("max_rows"):
        df = split.stratified_sample(df, ds.target, key, int(plan["max_rows"]), seed)
    target.require_feasible(df, ds.target, k)
    raw = df.drop(key)
    found = {
        "audit": audit.audit_summary(raw, ds.target, ds.display_name, ds.benign_labels, ds.task, ds.metadata.get("dataset_fingerprint", "")),
        "label_counts": audit.label_counts(raw, ds.target, ds.display_name),
        "loader_metadata": metadata,
    }
    roles = [list(spec.get(r, ())) for r in ("drop_columns", "identifier_columns", "leakage_columns")]
    rows = prep.drop_roles(df, ds.target, *roles)
    if spec.get("recipe"):
        rows = prep.apply_recipe(rows, ds.target, spec["recipe"])
    parts = split.stratified_holdout(rows, ds.target, key, seed, float(plan.get("test_size", 0.2))).persist()
    train, test = parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split")
    target.require_feasible(train, ds.target, k)
    model = prep.fit(train, ds.target, [key], spec.get("numeric_columns", ()), spec.get("missing_value_tokens", ()))
    x_train = model.transform(train, [key])
    x_test = model.transform(test, [key])
    found["artifacts"] = model.artifacts().select(F.lit(ds.name).alias("dataset"), "*")
    folded = split.stratified_folds(x_train, "label", key, k, seed)
    found["folds"] = folded.select(F.lit(ds.name).alias("dataset"), key, "fold")
    # rankings of an earlier run on the same data are taken as they are; only methods it lacks are computed
    earlier = read_stored(spark, f"{root}/rankings") if root else None
    reused = None
    if earlier is not None:
        done = earlier.filter((F.col("dataset") == ds.name) & (F.col("status") == "ok") & F.col("method").isin(*plan["methods"]))
        reused = local_table(spark, [tuple(r) for r in done.select(*suite_columns()).collect()], suite.RANKING_SCHEMA)  # features x methods rows
    have = {r["method"] for r in reused.select("method").distinct().collect()} if reused is not None else set()
    todo = [m for m in plan["methods"] if m not in have]
    parts_ranked = [reused] if have else []
    if todo:
        parts_ranked.append(suite.run_suite(ds.name, x_train, "label", key, model.features, todo, int(plan.get("max_fit_rows", suite.MAX_FIT_ROWS)), seed, plan.get("ranker_options")))
    found["rankings"] = audit.combine(parts_ranked)
    require_rankings(found["rankings"])
    found["candidates"] = subsets.candidate_sets(found["rankings"], plan.get("criteria", ("q25", "q50")), int(plan.get("min_features", 3)))
    grid = Grid(ds.name, folded, x_test, "label", model.features, k, seed, plan.get("classifier_options"), plan.get("baselines"))
    log = f"{root}/log/{ds.name}" if root else None
    results, folds, timings = evaluate_grid(
        grid, found["candidates"], plan["classifiers"], int(plan.get("repeats", 3)), int(plan.get("warmup", 1)), int(plan.get("parallelism", 4)), log)
    return {**found, "evaluations": results, "fold_metrics": folds, "timings": timings}


def run(spark: SparkSession, specs: Sequence[Mapping], plan: Mapping, root: str | None = None) -> dict[str, DataFrame]:
    """Study every dataset, stack the tables, analyse them; with ``root`` everything is also written as Parquet."""
    each = [study_dataset(spark, load_dataset(spark, s), s, plan, root) for s in specs]
    tables = {name: audit.combine([e[name] for e in each]) for name in each[0]}
    if root:
        # stored tables cut the lineage before the analysis reads them several times
        for name in ("rankings", "candidates", "evaluations", "timings", "fold_metrics", "audit", "label_counts", "loader_metadata", "artifacts", "folds"):
            tables[name] = spark.read.parquet(write_table(tables[name], root, name))
    def stored(name: str, df: DataFrame) -> DataFrame:
        return spark.read.parquet(write_table(df, root, name))

    tables |= analyze(
        tables["rankings"], tables["candidates"], tables["evaluations"], tables["timings"],
        plan["scenarios"], plan["zones"], plan.get("metric_source", "cross_validation"), store=stored if root else None)
    if root:
        for name in ("champion_stability", "retention_cost", "core_coverage", "core_membership", "classifier_matrix", "timing_memory"):
            write_table(tables[name], root, name)
        write_exports(tables["core_features"], root, "core_features", ["dataset"])
        write_exports(tables["champion_features"], root, "champion_features", ["dataset", "classifier", "scenario", "zone"])
        tables["evidence"] = evidence_catalog(spark, root, EVIDENCE)
    return tables


def validate_only(spark: SparkSession, specs: Sequence[Mapping], n_splits: int = 10) -> DataFrame:
    """Row, feature and class counts of every dataset, without running the study."""
    loaded = [load_dataset(spark, s) for s in specs]
    return audit.combine([audit.validation_report(d.name, d.df, d.target, n_splits) for d in loaded])


def analysis_only(spark: SparkSession, root: str, plan: Mapping) -> dict[str, DataFrame]:
    """Rebuild all analysis tables from the stored ones below ``root``."""
    def stored(name: str) -> DataFrame | None:
        return read_stored(spark, f"{root}/{name}")

    return analyze(stored("rankings"), stored("candidates"), stored("evaluations"), stored("timings"), plan["scenarios"], plan["zones"], plan.get("metric_source", "cross_validation"))
