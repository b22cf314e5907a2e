"""Classification metrics from confusion counts, for any number of models in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import safe_div

CV_METRICS = ("accuracy", "precision", "recall", "f1", "macro_DR", "macro_FAR", "macro_BCI")


def confusion_counts(predictions: DataFrame, keys: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """(keys, y_true, y_pred, n); equal outcomes combine before the shuffle."""
    return predictions.groupBy(*keys, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))


def metrics_of(confusion: DataFrame, keys: Sequence[str], n_labels: int) -> DataFrame:
    """Accuracy, weighted precision/recall/F1, macro recall/FAR/BCI over all ``n_labels`` labels, one-vs-rest sums.

    A label without rows on either side counts as recall 0, FAR 0 and specificity 1.
    """
    keys = list(keys)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y_true").alias("c"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero).alias("tp")),
        F.struct(F.col("y_pred").alias("c"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    cells = confusion.select(*keys, "n", F.explode(sides).alias("s"))
    per_class = cells.groupBy(*keys, "s.c").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp"))
    totals = confusion.groupBy(*keys).agg(F.sum("n").alias("total"))
    m = per_class.join(totals, keys)
    fp, fn = F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    tn = F.col("total") - F.col("predicted") - F.col("support") + F.col("tp")
    recall, precision = safe_div(F.col("tp"), F.col("support")), safe_div(F.col("tp"), F.col("predicted"))
    far, specificity = safe_div(fp, F.col("total") - F.col("support")), safe_div(tn, F.col("total") - F.col("support"))
    f1 = safe_div(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    weight = F.col("support") / F.col("total")
    absent = F.lit(n_labels) - F.count("*")

    def macro(c: Column, of_absent: float = 0.0) -> Column:
        return (F.sum(c) + absent * F.lit(of_absent)) / F.lit(float(n_labels))

    return m.groupBy(*keys).agg(
        safe_div(F.sum("tp"), F.max("total")).alias("accuracy"),
        F.sum(weight * precision).alias("precision"), F.sum(weight * recall).alias("recall"), F.sum(weight * f1).alias("f1"),
        macro(recall).alias("macro_DR"), macro(far).alias("macro_FAR"), macro((recall + specificity) / 2, 0.5).alias("macro_BCI"),
        F.sum("tp").alias("TP_sum"), F.sum(fp).alias("FP_sum"),
        (F.sum(tn) + absent * F.max("total")).alias("TN_sum"), F.sum(fn).alias("FN_sum"),
    )


def confusion_json(confusion: DataFrame, keys: Sequence[str], n_labels: int) -> DataFrame:
    """(keys, confusion_matrix_json, encoded_labels_json) with labels 0..n_labels-1."""
    rows = F.sequence(F.lit(0), F.lit(n_labels - 1))
    cells = F.map_from_entries(F.collect_list(F.struct(
        (F.col("y_true").cast("int") * n_labels + F.col("y_pred").cast("int")).alias("at"), F.col("n"))))
    at = confusion.groupBy(*keys).agg(cells.alias("cells"))  # at most n_labels^2 entries
    matrix = F.transform(rows, lambda i: F.transform(rows, lambda j: F.coalesce(F.try_element_at("cells", i * n_labels + j), F.lit(0))))
    return at.select(*keys, F.to_json(matrix).alias("confusion_matrix_json"), F.to_json(rows).alias("encoded_labels_json"))


def cv_summary(fold_metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of the seven fold metrics."""
    aggs = []
    for m in CV_METRICS:
        aggs += [F.avg(m).alias(f"cv_{m}_mean"), F.try_divide(F.stddev_samp(m), F.lit(1.0)).alias(f"cv_{m}_std")]
    return fold_metrics.groupBy(*keys).agg(*aggs)


def timing_summary(timings: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = "inference_time_ms_per_sample"
    name = "final_inference_time_ms_per_sample"
    return timings.groupBy(*keys).agg(
        F.avg(t).alias(f"{name}_mean"), F.stddev_samp(t).alias(f"{name}_std"), F.min(t).alias(f"{name}_min"), F.max(t).alias(f"{name}_max"))
