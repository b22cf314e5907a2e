"""Small state: what may reach the driver, what may be broadcast, how lineage is cut."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

BROADCAST_ROWS = 200_000


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A table of a few rows the planner holds itself: no Python job, and its size is known."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [()] * len(kind.fields)
    arrow = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), kind)


def bounded_rows(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Fetch a table that is expected to be small and prove it.

    Returns (local table, True) when it has at most ``max_rows`` rows; the size
    of a local table is known to the planner. Otherwise (df, False): the
    caller's join stays a shuffle join.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df, False
    return local_table(df.sparkSession, rows, df.schema), True


def spread_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for broadcast when its checked size allows, else unchanged."""
    small, proven = bounded_rows(df, max_rows)
    return F.broadcast(small) if proven else small


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir, or one in the warehouse, which executors share as well."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return
    if sc.getCheckpointDir() is not None:
        return
    sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
