"""Report tables: one Parquet folder per table below a run folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = ("dataset",), mode: str = "overwrite") -> str:
    """Write one named table, partitioned by those of ``partition_by`` it has."""
    keys = [c for c in partition_by if c in df.columns]
    path = f"{root.rstrip('/')}/{name}"
    writer = df.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    return path


def write_exports(features: DataFrame, root: str, name: str, keys: Sequence[str]) -> str:
    """One folder of feature names per key combination, so that no list overwrites another."""
    return write_table(features, root, name, partition_by=keys)


def evidence_catalog(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """(name, rows, present) for the expected report tables of a run."""
    parts = []
    for name in names:
        try:
            table = spark.read.parquet(f"{root.rstrip('/')}/{name}")
            part = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(True).alias("present"))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            part = spark.range(1).select(F.lit(name).alias("name"), F.lit(None).cast("bigint").alias("rows"), F.lit(False).alias("present"))
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
