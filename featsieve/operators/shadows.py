"""Whole-table column permutations: shuffled copies of columns that every row takes part in.

Rows are ranked once by the hash of their keys (a range partition, and the counts of the partitions before). A keyed
bijection of the ranks, a Feistel network that walks until it is inside the table, then says where each value of a
column goes: one shuffle moves all columns of a round. No block or group is formed, and the result is a function of the
keys and the seed. ``shadow_blocks`` does this for many rounds at once with bin codes instead of values, packed by the
place they go to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import cut_lineage, hash32, spread_broadcast
from .binned import BLOCK_ROWS, code_columns, salted

FEISTEL_ROUNDS = 6
IN_PARTITION = (1 << 33) - 1  # the lower bits of monotonically_increasing_id


def permuted(places: np.ndarray, n: int, *salts: int) -> np.ndarray:
    """A bijection of 0..n-1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, left = places.astype(np.uint64), np.arange(len(places))
    while len(left):
        a, b = out[left] >> np.uint64(half), out[left] & mask
        for r in range(FEISTEL_ROUNDS):
            a, b = b, a ^ (salted(b, *salts, r) & mask)
        out[left] = (a << np.uint64(half)) | b
        left = left[out[left] >= n]
    return out.astype(np.int64)


def ranked_rows(df: DataFrame, label: str, key: str, features: Sequence[str], seed: int) -> tuple[DataFrame, int]:
    """(rows with label, f0.., a unique key and their ``rank`` from 0 in hash order, number of rows)."""
    rows = df.select(F.col(label).alias("label"), F.col(key).alias("key"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    rows = rows.withColumn("_h", hash32(F.col("key"), seed, "shadow"))
    placed = cut_lineage(rows.repartitionByRange("_h", "key").sortWithinPartitions("_h", "key").withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    starts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"), "count")
    n = starts.agg(F.sum("count")).head()[0] or 0
    joined = placed.join(spread_broadcast(starts.drop("count")), F.shiftright("_at", 33) == F.col("_part"))
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit(IN_PARTITION))
    return joined.select("label", "key", *[f"f{i}" for i in range(len(features))], rank.alias("rank")), n


def with_shadows(ranked: DataFrame, n: int, columns: int, round_: int, seed: int) -> DataFrame:
    """label, key, f0.. and s0..: each s column is a permutation of its f column over the whole table."""
    schema = pa.schema([("rank", pa.int64()), ("column", pa.int32()), ("value", pa.float64())])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks = b.column(0).to_numpy()
            for j in range(columns):
                yield pa.RecordBatch.from_arrays([pa.array(permuted(ranks, n, seed, round_, j)), pa.array(np.full(len(ranks), j, np.int32)), b.column(1 + j)], schema=schema)

    moved = ranked.select("rank", *[f"f{j}" for j in range(columns)]).mapInArrow(move, "rank long, column int, value double")
    shadows = moved.groupBy("rank").agg(*[F.max(F.when(F.col("column") == j, F.col("value"))).alias(f"s{j}") for j in range(columns)])
    return ranked.join(shadows, "rank").drop("rank")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of four blocks' rows where a partition has as many: the work per batch is worth it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= 4 * BLOCK_ROWS:
            yield pa.concat_batches(held)
            held = []
    if sum(h.num_rows for h in held):
        yield pa.concat_batches(held)


def shadow_blocks(ranked: DataFrame, n: int, edges: Sequence[np.ndarray], rounds: Sequence[int], seed: int) -> DataFrame:
    """Blocks (model: the round; n, codes, y, id) of the rows ``with_shadows`` makes in ``rounds``, as bin codes of f0.. and s0.."""
    p = len(edges)
    sent = pa.schema([("model", pa.int32()), ("chunk", pa.int32()), ("column", pa.int32()), ("at", pa.binary()), ("codes", pa.binary()), ("y", pa.binary()), ("id", pa.binary())])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _joined(batches):
            y, ids, ranks = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            codes = code_columns([b.column(3 + j).to_numpy(zero_copy_only=False) for j in range(p)], edges)
            for round_ in rounds:
                rows = []
                for j in range(-1, p):  # the rows themselves, then each column's values where they go
                    to = ranks if j < 0 else permuted(ranks, n, seed, round_, j)
                    order = np.argsort(to, kind="stable")
                    chunk, at = to[order] // BLOCK_ROWS, (to[order] % BLOCK_ROWS).astype(np.uint16)
                    ends = np.append(np.flatnonzero(np.diff(chunk)) + 1, len(chunk))
                    for first, end in zip([0, *ends[:-1]], ends):
                        own = order[first:end]
                        base = (codes[own].tobytes(), y[own].astype(np.int32).tobytes(), ids[own].astype(np.int64).tobytes()) if j < 0 else (codes[own, j].tobytes(), None, None)
                        rows.append((round_, int(chunk[first]), j, at[first:end].tobytes(), *base))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), sent)], schema=sent)

    def assemble(key: tuple, part: pa.Table) -> pa.Table:
        size = min(BLOCK_ROWS, n - key[1].as_py() * BLOCK_ROWS)
        codes, y, ids = np.empty((size, 2 * p), np.uint8), np.empty(size, np.int32), np.empty(size, np.int64)
        for r in part.to_pylist():
            at = np.frombuffer(r["at"], np.uint16)
            if r["column"] < 0:
                codes[at, :p], y[at], ids[at] = np.frombuffer(r["codes"], np.uint8).reshape(-1, p), np.frombuffer(r["y"], np.int32), np.frombuffer(r["id"], np.int64)
            else:
                codes[at, p + r["column"]] = np.frombuffer(r["codes"], np.uint8)
        return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([size], pa.int32()), "codes": [codes.tobytes()], "y": [y.tobytes()], "id": [ids.tobytes()]})

    spread = max(ranked.sparkSession.sparkContext.defaultParallelism, n // (4 * BLOCK_ROWS))
    plain = ranked.repartition(spread, "rank").select(F.col("label").cast("int"), F.xxhash64(F.col("key").cast("string")).alias("id"), "rank", *[f"f{j}" for j in range(p)])
    moved = plain.mapInArrow(move, "model int, chunk int, column int, at binary, codes binary, y binary, id binary")
    return moved.groupBy("model", "chunk").applyInArrow(assemble, "model int, n int, codes binary, y binary, id binary")


def shadow_report(df: DataFrame, label: str, key: str, features: Sequence[str], seed: int = 42, round_: int = 0) -> DataFrame:
    """Per feature: rows, distinct values and sum of its shadow, values whose count differs from the feature's, and whether most rows moved."""
    ranked, n = ranked_rows(df, label, key, features, seed)
    both = cut_lineage(with_shadows(ranked, n, len(features), round_, seed))
    pairs = both.select(F.posexplode(F.array(*[F.struct(F.col(f"f{i}").alias("f"), F.col(f"s{i}").alias("s")) for i in range(len(features))])).alias("pos", "v")).select("pos", "v.*")
    counts = pairs.select("pos", F.explode(F.array(F.struct(F.col("f").alias("v"), F.lit(1).alias("n")), F.struct(F.col("s").alias("v"), F.lit(-1).alias("n")))).alias("x")).groupBy("pos", "x.v").agg(F.sum("x.n").alias("n"))
    wrong = counts.groupBy("pos").agg(F.count_if(F.col("n") != 0).alias("unmatched"), F.count("v").alias("distinct_values"))
    moved = pairs.groupBy("pos").agg(F.count("*").alias("rows"), F.sum("s").alias("total"), F.count_if(~F.col("f").eqNullSafe(F.col("s"))).alias("moved"))
    names = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("pos") + 1)
    return moved.join(wrong, "pos").select(names.alias("feature"), "rows", "distinct_values", "total", "unmatched", (F.col("moved") > 0).alias("shuffled"))
