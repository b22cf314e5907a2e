"""ReliefF: nearest neighbours of every row, of the whole table or of a stratified sample.

Without ``max_rows`` all rows take part, by an exact nearest-neighbour join (``neighbors``). With it the sample is the operator's own bound (``max_rows``). It is shipped to the
tasks once; each task finds the neighbours of its rows with blockwise numpy
distances and emits one partial score vector, so no pair leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import local_table
from .neighbors import nearest_rows
from .split import stratified_sample

MAX_SAMPLE_CELLS = 50_000_000
BLOCK_ROWS = 256


def relief_scores(
    df: DataFrame, label: str, key: str, features: Sequence[str], neighbors: int = 10, max_rows: int | None = 5000, seed: int = 42
) -> DataFrame:
    """(pos, score): mean distance to other-class minus same-class rows among the nearest neighbours."""
    features = list(features)
    if max_rows is None:
        return _whole_scores(df, label, key, features, neighbors, seed)
    if max_rows * len(features) > MAX_SAMPLE_CELLS:
        raise ValueError(f"a sample of {max_rows} rows x {len(features)} features is too large to ship to the tasks")
    spark = df.sparkSession
    columns = [F.col(key).cast("string").alias("key"), F.col(label).cast("double").alias("y")]
    sample = stratified_sample(df, label, key, max_rows, seed).select(
        *columns, F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x"))
    base = sample.toPandas().sort_values("key", kind="stable").reset_index(drop=True)  # <= max_rows rows by construction
    n = len(base)
    if n < 3:
        return local_table(spark, [(i, 0.0) for i in range(len(features))], "pos int, score double")
    shipped = spark.sparkContext.broadcast((np.stack(base["x"].to_numpy()), base["y"].to_numpy()))
    take = min(neighbors, n - 1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = shipped.value
        total = np.zeros(x.shape[1])
        for pdf in batches:
            for at in np.array_split(pdf["row"].to_numpy(), max(1, len(pdf) // BLOCK_ROWS)):
                total += _block_scores(x, y, at, take)
        yield pd.DataFrame({"pos": np.arange(len(total)), "part": total / len(y)})

    slices = min(spark.sparkContext.defaultParallelism, max(1, n // BLOCK_ROWS))
    parts = spark.range(0, n, 1, slices).withColumnRenamed("id", "row").mapInPandas(score, "pos int, part double")
    return parts.groupBy("pos").agg(F.sum("part").alias("score"))


def _whole_scores(df: DataFrame, label: str, key: str, features: list[str], neighbors: int, seed: int, **pieces: int) -> DataFrame:
    p = len(features)
    near, rows, n = nearest_rows(df, key, label, features, neighbors, seed, **pieces)
    if n < 3:
        return local_table(df.sparkSession, [(i, 0.0) for i in range(p)], "pos int, score double")
    hits = F.size(F.filter("near", lambda m: m["y"] == F.col("y")))
    each = near.select("key", "y", hits.alias("hits"), (F.size("near") - hits).alias("misses"), F.explode("near").alias("m"))
    weight = F.when(F.col("m.y") == F.col("y"), -1.0 / F.col("hits")).otherwise(1.0 / F.col("misses"))
    pairs = each.select("key", F.col("m.key").alias("other"), weight.alias("weight"))
    pairs = pairs.join(rows.select("key", "x"), "key").join(rows.select(F.col("key").alias("other"), F.col("x").alias("z")), "other")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p)
        for b in batches:
            x, z = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.float64).reshape(-1, p) for i in (1, 2))
            total += b.column(0).to_numpy() @ np.abs(x - z)
        yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(p, dtype=np.int32)), "part": total / n})

    parts = pairs.select("weight", "x", "z").mapInArrow(score, "pos int, part double")
    return parts.groupBy("pos").agg(F.sum("part").alias("score"))


def _block_scores(x: np.ndarray, y: np.ndarray, at: np.ndarray, take: int) -> np.ndarray:
    if not len(at):
        return np.zeros(x.shape[1])
    d = np.zeros((len(at), len(x)))
    for j in range(x.shape[1]):
        d += (x[at, j][:, None] - x[None, :, j]) ** 2
    d = np.round(np.sqrt(d), 9)
    d[np.arange(len(at)), at] = np.inf
    # rows are in key order, so a stable sort breaks ties by key
    near = np.argsort(d, axis=1, kind="stable")[:, :take]
    gaps = np.abs(x[at][:, None, :] - x[near])
    out = np.zeros(x.shape[1])
    for same, sign in ((True, -1.0), (False, 1.0)):
        member = (y[near] == y[at][:, None]) == same
        count = member.sum(axis=1)
        mean = (gaps * member[:, :, None]).sum(axis=1) / np.maximum(count, 1)[:, None]
        out += sign * mean.sum(axis=0)
    return out
