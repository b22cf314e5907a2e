"""Reports over champions: stability, retention, core coverage, report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import safe_div

MATRIX_COLUMNS = (
    "dataset", "classifier", "experiment_role", "zone", "method", "criterion", "num_features", "accuracy", "precision",
    "recall", "f1", "macro_FAR", "final_training_plus_prediction_time_s", "final_inference_time_ms_per_sample_mean",
    "feature_set_id",
)


def champion_stability(champions: DataFrame) -> DataFrame:
    """Does the same feature set win under every scenario? Lists follow scenario order."""
    seen = F.array_sort(F.collect_list(F.struct("scenario_idx", "feature_set_id", "method")))  # one entry per scenario
    n_sets = F.count_distinct("feature_set_id")
    g = champions.groupBy("dataset", "classifier", "zone").agg(
        F.count("*").alias("num_scenarios"), n_sets.alias("num_unique_feature_sets"),
        F.count_distinct("method").alias("num_unique_methods"),
        (n_sets == 1).alias("stable_same_feature_set_across_scenarios"), seen.alias("_seen"))
    return g.withColumn("feature_sets_by_scenario", F.array_join("_seen.feature_set_id", ";")).withColumn(
        "methods_by_scenario", F.array_join("_seen.method", ";")).drop("_seen")


def retention_cost(champions: DataFrame, reference_zone: str = "effectiveness") -> DataFrame:
    """Each champion against the reference-zone champion of its group; groups without one are dropped."""
    keys = ["dataset", "classifier", "scenario"]
    train, infer = "final_training_plus_prediction_time_s", "final_inference_time_ms_per_sample_mean"
    used = ["accuracy", "f1", train, infer, "num_features"]
    ref = champions.filter(F.col("zone") == reference_zone).select(*keys, *[F.col(c).alias(f"_ref_{c}") for c in used])

    def ratio(a: str, b: str) -> Column:
        return safe_div(F.col(a), F.col(b), None)

    return champions.join(ref, keys).select(
        *keys, "zone", F.lit(reference_zone).alias("reference_zone"),
        ratio("accuracy", "_ref_accuracy").alias("accuracy_retention_vs_reference"),
        ratio("f1", "_ref_f1").alias("f1_retention_vs_reference"),
        ratio(f"_ref_{train}", train).alias("training_time_reduction_factor"),
        ratio(f"_ref_{infer}", infer).alias("inference_time_reduction_factor"),
        ratio("_ref_num_features", "num_features").alias("feature_reduction_factor"),
    )


def _with_core(champions: DataFrame, tiers: DataFrame) -> DataFrame:
    core = tiers.filter("tier = 1").groupBy("dataset").agg(F.collect_set("feature").alias("_core"))  # features of a dataset
    selected = F.array_distinct(F.filter(F.split(F.coalesce("selected_features", F.lit("")), ";"), lambda x: x != ""))
    none = F.array().cast("array<string>")
    return champions.join(core, "dataset", "left").withColumn("_core", F.coalesce("_core", none)).withColumn("_selected", selected)


def core_coverage(champions: DataFrame, tiers: DataFrame) -> DataFrame:
    """How much of the core a champion selects, and how much of its selection is core."""
    both = F.size(F.array_intersect("_selected", "_core"))
    return _with_core(champions, tiers).select(
        "dataset", "scenario", "zone", "method", "criterion", "classifier",
        F.size("_core").alias("num_core_features"), F.size("_selected").alias("num_selected_features"), both.alias("num_intersection"),
        safe_div(both, F.size("_core")).alias("core_coverage_recall"), safe_div(both, F.size("_selected")).alias("core_purity_alignment"),
    )


def core_membership(champions: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per champion and feature of selection or core: in which of the two it is."""
    each = _with_core(champions, tiers).withColumn("feature", F.explode(F.array_union("_selected", "_core")))
    in_core, in_selected = F.array_contains("_core", F.col("feature")), F.array_contains("_selected", F.col("feature"))
    return each.select(
        "dataset", "classifier", "scenario", "zone", "feature",
        in_core.alias("in_core"), in_selected.alias("in_selected"), (in_core & in_selected).alias("in_intersection"))


def classifier_matrix(champions: DataFrame, scenario: str = "equal", columns: Sequence[str] = MATRIX_COLUMNS) -> DataFrame:
    return champions.filter(F.col("scenario") == scenario).select(*[c for c in columns if c in champions.columns])


def timing_memory(timings: DataFrame) -> DataFrame:
    """Timing and memory per (dataset, classifier, feature_set_id); null keys form groups of their own."""
    return timings.groupBy("dataset", "classifier", "feature_set_id").agg(
        F.avg("inference_time_ms_per_sample").alias("inference_time_ms_per_sample_mean"),
        F.stddev_samp("inference_time_ms_per_sample").alias("inference_time_ms_per_sample_std"),
        F.avg("cpu_memory_mb").alias("cpu_memory_mb_mean"), F.max("gpu_peak_memory_mb").alias("gpu_peak_memory_mb_max"))


def role_tag(results: DataFrame, baselines: dict[str, str]) -> DataFrame:
    """experiment_role: the dataset's configured baseline classifier or a member of the controlled matrix."""
    is_baseline = F.lit(False)
    for dataset, classifier in baselines.items():
        is_baseline = is_baseline | ((F.col("dataset") == dataset) & (F.col("classifier") == classifier))
    return results.withColumn("experiment_role", F.when(is_baseline, "original_baseline").otherwise("controlled_classifier_matrix"))
