"""Operator 2: nearest neighbours by inner product with an inverted multi-index.

Vectors are cut in two halves and each half is quantised by its own k-means codebook; a pair of centroids is a cell. A
query walks the cells by falling sum of its two halves' inner products with the centroids (a heap over the two
sorted lists, never the whole square) until it has seen enough candidates, and these are reranked on the original vectors.
How many are enough is measured: for a sample of queries the true neighbours are found by brute force over all rows, and
the walk is made long enough to meet ``target_recall`` of them.

Codebooks are fitted on a bounded sample drawn by a hash; every valid row is indexed. Entries of a cell, and queries that
visit it, meet in groups of bounded size: large cells are split, and so are the queries that come to them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import stored

SAMPLE_ROWS, SAMPLE_QUERIES = 16_384, 96
TARGET_RECALL = 0.95
CELL_ROWS, MAX_CENTROIDS = 8, 512
SHARD_ROWS, BLOCK_QUERIES = 8_192, 2_048


@dataclass
class Index:
    left: np.ndarray  # centroids of the first half
    right: np.ndarray
    counts: np.ndarray  # entries by cell
    candidates: int = 0  # entries a walk must see

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        half = self.left.shape[1]
        return _nearest(vectors[:, :half], self.left) * len(self.right) + _nearest(vectors[:, half:], self.right)

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Cells by falling sum of centroid products; empty ones are left out."""
        half = self.left.shape[1]
        a, b = self.left @ query[:half], self.right @ query[half:]
        first, second = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b = a[first].tolist(), b[second].tolist()
        n_right, counts = len(second), self.counts
        heap, reached = [(-(a[0] + b[0]), 0, 0)], [0] * len(first)  # reached: columns opened in a row
        reached[0] = 1
        while heap:
            _, i, j = heapq.heappop(heap)
            cell = first[i] * n_right + second[j]
            if counts[cell]:
                yield cell
            # a place is opened when its left and its upper neighbour are done
            if j + 1 < n_right and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            reached[i] = max(reached[i], j + 1)
            if i + 1 < len(first) and reached[i + 1] == j and (j == 0 or reached[i + 1] >= j):
                heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))

    def visited(self, query: np.ndarray) -> np.ndarray:
        out, seen = [], 0
        for cell in self.walk(query):
            out.append(cell)
            seen += int(self.counts[cell])
            if seen >= self.candidates:
                break
        return np.asarray(out, np.int32)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centroids)
        size = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, weights=x[:, c], minlength=len(centroids)) for c in range(x.shape[1])], axis=1)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.integers(len(x), size=len(centroids))])
    return centroids


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): one row per id, vectors of the commonest length that are finite and not zero."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter("vec_id is not null and v is not null")
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter((F.size("v") == (sizes["size"] if sizes else 0)) & finite)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order whatever rows stand beside."""
    return (vectors * query).sum(axis=1)


def _best(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    rough = vectors @ query
    rough[ids == own] = -np.inf
    if len(rough) > k:
        floor = np.partition(rough, len(rough) - k)[len(rough) - k]
        picked = np.flatnonzero(rough >= floor - 1e-9 * max(1.0, abs(floor)) if np.isfinite(floor) else np.isfinite(rough))
    else:
        picked = np.flatnonzero(np.isfinite(rough))
    score = _exact(vectors[picked], query)
    order = np.lexsort((ids[picked], -score))[:k]
    return ids[picked][order], score[order]


def build(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Index, DataFrame] | None:
    """Codebooks and the indexed entries (vec_id, v, cell); None for an empty table."""
    n = vectors.count()
    if not n:
        return None
    drawn = F.pmod(F.xxhash64(F.lit("codebook"), "vec_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = vectors.filter(drawn < min(1.0, sample_rows / n)).limit(2 * sample_rows).collect() or vectors.limit(1).collect()
    x = np.asarray([r["v"] for r in sorted(sample, key=lambda r: r["vec_id"])], np.float64)
    half = max(1, x.shape[1] // 2)
    k = max(1, min(MAX_CENTROIDS, round(math.sqrt(n / CELL_ROWS)), len(x)))
    index = Index(k_means(x[:, :half], k), k_means(x[:, half:], k), np.zeros(0, np.int64))
    shipped = vectors.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = shipped.value.cells(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.astype(np.int32))], names=["vec_id", "v", "cell"])

    kind = vectors.schema["v"].dataType.simpleString()
    entries = stored(vectors.mapInArrow(assign, f"vec_id long, v {kind}, cell int"), "entries")
    index.counts = np.zeros(len(index.left) * len(index.right), np.int64)
    for r in entries.groupBy("cell").count().collect():  # a row per cell, bounded by the codebooks
        index.counts[r["cell"]] = r["count"]
    return index, entries


def tune(index: Index, entries: DataFrame, queries: DataFrame, k: int, target: float = TARGET_RECALL, sample_queries: int = SAMPLE_QUERIES) -> float:
    """Set the walk's length from brute force on a sample of queries; returns the recall there."""
    sample = queries.orderBy(F.xxhash64(F.lit("tune"), "query_id"), "query_id").limit(sample_queries).collect()
    shipped = entries.sparkSession.sparkContext.broadcast([(r["query_id"], np.asarray(r["v"], np.float64)) for r in sample])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cells, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(1))
            cell_of = dict(zip(ids.tolist(), cells.tolist()))
            for own, query in shipped.value:
                near, score = _best(ids, x, query, own, k)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.full(len(near), own)), "vec_id": pa.array(near), "cell": pa.array([cell_of[i] for i in near.tolist()], pa.int32()), "score": pa.array(score)})

    found = entries.select("vec_id", "v", "cell").mapInArrow(nearest, "query_id long, vec_id long, cell int, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    truth: dict[int, list[int]] = {}
    for r in found.withColumn("rank", rank).filter(F.col("rank") <= k).collect():  # k rows per sampled query
        truth.setdefault(r["query_id"], []).append(r["cell"])
    needed: list[int] = []
    for own, query in shipped.value:
        left, seen = dict.fromkeys(truth.get(own, []), 0), 0
        missing = set(left)
        for cell in index.walk(query):
            left[cell] = seen  # entries before the cell
            seen += int(index.counts[cell])
            missing.discard(cell)
            if not missing:
                break
        needed += [left[c] + 1 for c in truth.get(own, [])]
    needed.sort()
    place = min(len(needed) - 1, math.ceil(target * len(needed)) - 1) if needed else -1
    index.candidates = max(4 * k, needed[place] if needed else 0)
    return sum(x <= index.candidates for x in needed) / len(needed) if needed else 1.0


def search(index: Index, entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query's walk."""
    spark = entries.sparkSession
    n_shards = max(1, math.ceil(int(index.counts.sum()) / SHARD_ROWS))
    # a cell above the shard size has shards of its own
    splits = np.maximum(1, -(-index.counts // SHARD_ROWS))
    own = splits > 1
    base = np.arange(len(index.counts)) % n_shards
    base[own] = n_shards + np.cumsum(splits[own]) - splits[own]
    shipped = spark.sparkContext.broadcast((index, base, splits))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, base, splits = shipped.value
        for batch in batches:
            cells = batch.column(2).to_numpy()
            part = (batch.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % splits[cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base[cells] + part)], names=["vec_id", "v", "cell", "shard"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base, splits = shipped.value
        for batch in batches:
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, 1))
            for i, query in enumerate(x):
                cells = index.visited(query)
                wide = np.repeat(cells, splits[cells])
                step = np.arange(len(wide)) - np.repeat(np.cumsum(splits[cells]) - splits[cells], splits[cells])
                shard = base[wide] + step
                order = np.argsort(shard, kind="stable")
                shard, wide = shard[order], wide[order]
                edges = np.flatnonzero(np.diff(shard, prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(shard)]):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([int(shard[a])], pa.int64()), pa.array([wide[a:b].tolist()], pa.list_(pa.int32()))],
                        names=["query_id", "q", "shard", "cells"])

    kind = entries.schema["v"].dataType.simpleString()
    placed = entries.select("vec_id", "v", "cell").mapInArrow(dealt, f"vec_id long, v {kind}, cell int, shard long")
    asked = stored(queries.select("query_id", F.col("v")).mapInArrow(visits, f"query_id long, q {kind}, shard long, cells array<int>"), "visits")
    blocks = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
    placed = placed.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")

    def rerank(part: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(part) and len(ask):
            part = part.sort_values(["cell", "vec_id"], ignore_index=True)
            ids, x = part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.float64)
            names, first = np.unique(part["cell"].to_numpy(), return_index=True)
            last = np.append(first[1:], len(part))
            for own, query, cells in zip(ask["query_id"], ask["q"], ask["cells"]):
                at = np.searchsorted(names, cells)
                at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == cells)]
                size = last[at] - first[at]
                rows = np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                near, score = _best(ids[rows], x[rows], np.asarray(query, np.float64), own, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": near, "score": score}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = placed.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET_RECALL) -> DataFrame:
    """The k nearest other rows, by inner product, of each row whose id is divisible by ``every``.

    Null, zero, non-finite or null-holding vectors and vectors of another than the commonest length take no part, nor do null
    ids; rows with one id count once (their least vector). Ties go to the smaller id. With k candidates or fewer all are given;
    an empty table gives no rows.
    """
    spark = df.sparkSession
    vectors = stored(valid_vectors(df, id_col, vector_col), "vectors")
    built = build(vectors)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, entries = built
    queries = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    tune(index, entries, queries, k, target)
    return search(index, entries, queries, k)


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
