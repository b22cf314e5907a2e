"""Target column: mapping, guards, task inference, missing tokens, class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from ..functions import folded, folded_text, local_table, spread_broadcast, stripped

TASKS = ("binary", "multiclass")
MAX_UNMAPPED = 100_000  # the list is metadata and held by the driver


def _label_text(c: Column, case_insensitive: bool) -> Column:
    return folded(stripped(c)) if case_insensitive else stripped(c)


def with_mapped_label(
    df: DataFrame, target: str, mapping: Mapping[str, str], case_insensitive: bool = False, out: str = "mapped"
) -> DataFrame:
    """Left lookup of the stripped label text in ``mapping``; null when not covered."""
    if not mapping:
        raise ValueError("the label mapping must not be empty")
    pairs = [(folded_text(str(k)) if case_insensitive else str(k).strip(), str(v)) for k, v in mapping.items()]
    table = local_table(df.sparkSession, list(dict(pairs).items()), f"_source string, {out} string")
    return (
        df.withColumn("_source", _label_text(F.col(target), case_insensitive))
        .join(F.broadcast(table), "_source", "left").drop("_source")
    )


def unmapped_labels(df: DataFrame, target: str, mapping: Mapping[str, str], case_insensitive: bool = False) -> DataFrame:
    """Distinct labels the mapping does not cover (nulls are not labels), with their row counts."""
    return (
        with_mapped_label(df, target, mapping, case_insensitive)
        .filter(F.col("mapped").isNull() & F.col(target).isNotNull())
        .groupBy(_label_text(F.col(target), case_insensitive).alias("label")).agg(F.count("*").alias("n_rows"))
    )


def map_labels(
    df: DataFrame, target: str, mapping: Mapping[str, str], case_insensitive: bool = False, default: str | None = None
) -> tuple[DataFrame, dict]:
    """Replace the target by its mapped value; unknown and null labels go to ``default`` when one is given."""
    rows = unmapped_labels(df, target, mapping, case_insensitive).select("label").orderBy("label").limit(MAX_UNMAPPED + 1).collect()
    if len(rows) > MAX_UNMAPPED:
        raise ValueError(f"column {target!r} holds over {MAX_UNMAPPED} labels outside the mapping; it is no class label")
    others = [r["label"] for r in rows]
    if others and default is None:
        raise ValueError(f"no mapping for {len(others)} labels, such as {others[:10]}, and no default to send them to")
    mapped = with_mapped_label(df, target, mapping, case_insensitive, "_mapped")
    value = F.col("_mapped") if default is None else F.coalesce("_mapped", F.lit(str(default)))
    out = mapped.withColumn(target, value).select(*df.columns)
    return out, {"target_mapping_default": default, "unmapped_labels": others}


def target_facts(df: DataFrame, target: str) -> DataFrame:
    """Rows, null targets, classes and the task they imply, in one aggregate over class counts."""
    classes = df.groupBy(F.col(target).alias("c")).agg(F.count("*").alias("n"))
    known = F.col("c").isNotNull()
    n_classes = F.count_if(known)
    return classes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_targets"),
        n_classes.alias("n_classes"),
        F.min(F.when(known, F.col("n"))).alias("smallest_class"),
        F.when(n_classes == 2, "binary").otherwise("multiclass").alias("task"),
    )


def resolve_task(name: str, target: str, facts: Row, task: str = "auto") -> str:
    """Apply the target guards to the facts and settle the task."""
    if facts["null_targets"]:
        raise ValueError(f"column {target!r} has rows without a label once the mapping is applied")
    if facts["n_classes"] < 2:
        raise ValueError(f"a single class is left in {name!r}; two or more are needed")
    task = task.lower()
    if task == "auto":
        return facts["task"]
    if task not in TASKS:
        raise ValueError(f"task {task!r} of {name!r} is none of {TASKS}")
    if task == "binary" and facts["n_classes"] != 2:
        raise ValueError(f"{name!r} holds {facts['n_classes']} classes, which a binary task does not allow")
    return task


def null_tokens(df: DataFrame, tokens: Sequence[str], target: str | None = None) -> DataFrame:
    """Missing-value tokens become null in the text feature columns; the target is left alone."""
    if not tokens:
        return df
    return df.select(*[
        F.when(F.col(f.name).isin(*tokens), None).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) and f.name != target
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def split_feasibility(df: DataFrame, target: str, n_splits: int) -> DataFrame:
    """Is the smallest class large enough for ``n_splits`` stratified folds?"""
    return target_facts(df, target).select(
        "n_classes", "smallest_class", F.lit(n_splits).alias("n_splits"),
        (F.coalesce("smallest_class", F.lit(0)) >= n_splits).alias("feasible"),
    )


def require_feasible(df: DataFrame, target: str, n_splits: int) -> None:
    row = split_feasibility(df, target, n_splits).head()
    if not row["feasible"]:
        raise ValueError(f"smallest class has {row['smallest_class']} rows, too few for {n_splits} stratified folds")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (K * n_c) per class; the class table is the only shuffled data."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    every_class = Window.partitionBy()  # one row per class
    total, k = F.sum("n_rows").over(every_class), F.count("*").over(every_class)
    return counts.select(label, "n_rows", (total / (k * F.col("n_rows"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(spread_broadcast(weights), label)
