"""Dataset audit: label distribution, benign counts, missing cells, duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import folded, folded_text, stripped
from .target import target_facts


def label_counts(df: DataFrame, target: str, dataset: str) -> DataFrame:
    """Rows per label, null kept, largest first."""
    return (
        df.groupBy(F.col(target).cast("string").alias("label")).agg(F.count("*").alias("count"))
        .select(F.lit(dataset).alias("dataset"), "label", "count")
        .orderBy(F.desc("count"), F.asc_nulls_first("label"))
    )


def benign_counts(df: DataFrame, target: str, benign: Sequence[str]) -> DataFrame:
    """Rows whose stripped, case-folded label is in ``benign`` and the rest; nulls when the set is empty."""
    return df.agg(*_benign_aggs(target, benign))


def _benign_aggs(target: str, benign: Sequence[str]) -> list[Column]:
    if not benign:
        return [
            F.lit(None).cast("bigint").alias("benign_or_normal_count"),
            F.lit(None).cast("bigint").alias("malicious_or_attack_count"),
        ]
    hit = F.coalesce(folded(stripped(F.col(target))).isin(*[folded_text(b) for b in benign]), F.lit(False))
    return [
        F.count_if(hit).alias("benign_or_normal_count"),
        F.count_if(~hit).alias("malicious_or_attack_count"),
    ]


def _missing(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier equal row (missing values equal each other).

    Rows are grouped by a 128-bit digest, so 16 bytes per row are shuffled
    instead of the table; equal rows are combined before the shuffle.
    """
    digest = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c + F.lit(0.0))  # NaN is missing, -0.0 is 0.0
        # the hash skips nulls, so their positions are hashed as well
        digest += [c.isNull(), c]
    rows = df.select(F.xxhash64(*digest).alias("a"), F.xxhash64(F.lit("second"), *digest).alias("b"))
    groups = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def audit_summary(
    df: DataFrame, target: str, dataset: str, benign: Sequence[str] = (), task: str | None = None, fingerprint: str = ""
) -> DataFrame:
    """The one-row audit of a table as loaded (before missing tokens are nulled)."""
    missing = reduce(lambda a, b: a + b, [_missing(f).cast("bigint") for f in df.schema.fields])
    counts = df.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_values_total"),
        *_benign_aggs(target, benign),
    )
    facts = target_facts(df, target).select("n_classes", F.col("task").alias("found_task"))
    # three one-row tables with different columns, folded into one row
    parts = combine([counts, facts, duplicate_rows(df)])
    one = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    return one.select(
        F.lit(dataset).alias("dataset"),
        F.col("rows").alias("raw_total_rows_after_loading"),
        F.lit(len(df.columns)).cast("bigint").alias("num_columns_after_loading"),
        F.lit(len(df.columns) - 1).cast("bigint").alias("num_features_before_preprocessing"),
        F.lit(target).alias("target_column"),
        (F.col("found_task") if task is None else F.lit(task)).alias("task"),
        F.col("n_classes").alias("num_target_classes"),
        "benign_or_normal_count", "malicious_or_attack_count", "missing_values_total", "duplicate_rows",
        F.lit(fingerprint).alias("dataset_fingerprint"),
    )


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack per-dataset tables; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def validation_report(dataset: str, df: DataFrame, target: str, n_splits: int) -> DataFrame:
    """Rows, features and classes of one dataset, and whether it can be split."""
    facts = target_facts(df, target)
    return facts.select(
        F.lit(dataset).alias("dataset"), F.col("n_rows").alias("rows"),
        F.lit(len(df.columns) - 1).cast("bigint").alias("features"),
        F.col("n_classes").alias("classes"), "smallest_class", "null_targets", "task",
        (F.coalesce("smallest_class", F.lit(0)) >= n_splits).alias("splittable"),
    )
