"""Shared pieces of the text operators: the shared folder, stored stages, per-worker caches, batch slicing."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def own_names(docs: DataFrame, core: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns beside the ``core`` ones under neutral names, and what selects the original columns back."""
    names = {c: c if c in core else f"_extra{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """An object kept by the Python worker process over its tasks (functions travel by value, so globals do not last)."""
    holder = sys.modules.setdefault("_featsieve_worker_cache", types.ModuleType("_featsieve_worker_cache"))
    if key not in holder.__dict__:
        made = make()  # may drop the cache
        holder = sys.modules.setdefault("_featsieve_worker_cache", holder)
        holder.__dict__[key] = made
    return holder.__dict__[key]


def drop_worker_cache() -> None:
    """Forget what the worker process keeps; the memory goes back to the system."""
    if sys.modules.pop("_featsieve_worker_cache", None) is not None:
        give_back_memory()


def sliced(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1_000_000, caching: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of a slice stays near ``max_bytes``; every row is in exactly one slice.

    Unless the operator is ``caching``, what other operators left in the worker's cache is dropped first.
    """
    import numpy as np
    import pyarrow.compute as pc

    if not caching:
        drop_worker_cache()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    give_back_memory()


def give_back_memory() -> None:
    """Return freed memory to the system: a worker process lives on and serves other tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
