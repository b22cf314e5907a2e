"""Append-only result log: rows arrive per finished combination, readers see the last one per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

COMBINATION = ("dataset", "feature_set_id", "classifier")


def append_results(rows: DataFrame, path: str) -> None:
    """Append one finished batch; files of earlier batches are never touched."""
    stamped = rows if "written_at" in rows.columns else rows.withColumn("written_at", F.current_timestamp())
    stamped.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_results(log: DataFrame, keys: Sequence[str] = COMBINATION, order: Column | str = "written_at") -> DataFrame:
    """The last written row per key, by an aggregate that combines before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(order) if isinstance(order, str) else order)
    return log.groupBy(*keys).agg(last.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*log.columns)


def completed_combinations(log: DataFrame) -> DataFrame:
    return log.select(*COMBINATION).dropna().distinct()


def pending_combinations(candidates: DataFrame, classifiers: Sequence[str], log: DataFrame | None = None) -> DataFrame:
    """Candidate x classifier combinations that are not in the log yet."""
    todo = candidates.withColumn("classifier", F.explode(F.array(*[F.lit(c) for c in classifiers])))
    return todo if log is None else todo.join(completed_combinations(log), list(COMBINATION), "left_anti")
