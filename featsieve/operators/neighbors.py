"""Exact nearest neighbours of every row by pivots.

Rows go to their nearest pivot. By the triangle inequality a row of another cell can be among a row's neighbours only if
the distance between the row and that cell's pivot, less the cell's radius, is not above the row's k-th distance. A first
pass takes each row's k-th distance within its own cell as a bound; the second pass sends each row to the pieces of cells
the bound does not rule out. Cells are cut into pieces of bounded size by a hash, so a pivot with a third of all rows is
many tasks' work. Distances are rounded to nine digits and ties go to the smaller key, as in the sampled form.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import cut_lineage, hash32, spread_broadcast
from .binned import number_columns

PIVOTS, PIVOT_CELLS = 256, 4_000_000  # pivots at most; their numbers are sent to the tasks
PIECE_ROWS = 2_048
BLOCK = 256
DIGITS = 9
EPSILON = 1e-8  # a bound is widened by more than rounding can move a distance


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed column by column so that a pair has the same one wherever it is compared."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j][:, None] - b[:, j][None]) ** 2
    return np.round(np.sqrt(out), DIGITS)


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def _nearest(x: np.ndarray, keys: np.ndarray, others: np.ndarray, other_keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``others``, distances) of each row's k nearest by (distance, key), itself left out; padded with -1 and inf."""
    order = np.argsort(other_keys, kind="stable")
    d = distances(x, others[order])
    d[keys[:, None] == other_keys[order][None]] = np.inf
    take = min(k, d.shape[1])
    near = np.argsort(d, axis=1, kind="stable")[:, :take]
    far = np.take_along_axis(d, near, axis=1)
    places = np.where(np.isinf(far), -1, order[near])
    if take < k:
        places = np.pad(places, ((0, 0), (0, k - take)), constant_values=-1)
        far = np.pad(far, ((0, 0), (0, k - take)), constant_values=np.inf)
    return places, far


def pieces_of(df: DataFrame, key: str, label: str, features: Sequence[str], seed: int, piece_rows: int = PIECE_ROWS, pivots: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray, dict[int, int], int]:
    """(rows with cell and piece, pivots, radius per cell, pieces per cell, rows); pivots are the rows with the least key hashes."""
    p = len(features)
    n = df.count()
    wanted = pivots or max(1, min(PIVOTS, PIVOT_CELLS // max(1, p), int(np.sqrt(n))))
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("y"), *number_columns(features))
    chosen = rows.orderBy(hash32(F.col("key"), seed, "pivot"), "key").limit(wanted).select(*[f"f{i}" for i in range(p)]).toPandas().to_numpy(float)
    home = rows.sparkSession.sparkContext.broadcast(chosen)
    schema = pa.schema([("key", pa.string()), ("y", pa.int32()), ("x", pa.binary()), ("cell", pa.int32()), ("far", pa.float64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x = np.column_stack([b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(p)])
                if np.isnan(x).any():
                    raise ValueError("neighbours need a number in every feature")
                d = distances(x, home.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array([_packed(r) for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], schema=schema)

    assigned = cut_lineage(rows.mapInArrow(assign, "key string, y int, x binary, cell int, far double"))
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # a row per pivot
    radius, parts = np.zeros(len(chosen)), {}
    for r in sizes:
        radius[r["cell"]], parts[r["cell"]] = r["radius"], -(-r["n"] // piece_rows)
    number = F.element_at(F.array(*[F.lit(parts.get(c, 1)) for c in range(len(chosen))]), F.col("cell") + 1)
    return assigned.withColumn("piece", F.pmod(hash32(F.col("key"), seed, "piece"), number).cast("int")), chosen, radius, parts, n


def nearest_rows(df: DataFrame, key: str, label: str, features: Sequence[str], k: int, seed: int = 42, piece_rows: int = PIECE_ROWS, pivots: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(key, y and ``near``: distance, key and y of its k nearest others, nearest first; all rows as key, y, x; their number).

    ``x`` packs the features as doubles. Fewer than k others give as many as there are.
    """
    p = len(features)
    rows, chosen, radius, parts, n = pieces_of(df, key, label, features, seed, piece_rows, pivots)
    rows = cut_lineage(rows)
    home = rows.sparkSession.sparkContext.broadcast((chosen, radius, parts))

    def own_bound(part: pa.Table) -> pa.Table:
        """The k-th distance within the row's own piece: no true k-th neighbour is farther."""
        x, keys = _unpacked(part["x"], p), np.asarray(part["key"].to_pylist(), object)
        bound = np.concatenate([_nearest(x[a : a + BLOCK], keys[a : a + BLOCK], x, keys, k)[1][:, k - 1] for a in range(0, len(x), BLOCK)])
        return part.select(["key", "x"]).append_column("bound", pa.array(bound))

    bounded = rows.groupBy("cell", "piece").applyInArrow(own_bound, "key string, x binary, bound double")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots_, radii, pieces = home.value
        per_cell = np.asarray([pieces.get(c, 0) for c in range(len(pivots_))])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                reach = distances(_unpacked(b.column(1), p), pivots_) - radii[None] <= b.column(2).to_numpy()[:, None] + EPSILON
                who, cell = np.nonzero(reach)
                counts = per_cell[cell]
                who, cell = np.repeat(who, counts), np.repeat(cell, counts)
                piece = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(who)) for c in b.columns] + [pa.array(cell.astype(np.int32)), pa.array(piece.astype(np.int32))], names=["key", "x", "bound", "cell", "piece"])

    asked = cut_lineage(bounded.mapInArrow(visit, "key string, x binary, bound double, cell int, piece int"))
    # rows that ask a piece come in bounded lots, each with a copy of the piece
    lots = asked.groupBy("cell", "piece").count().select("cell", "piece", F.ceil(F.col("count") / (4 * piece_rows)).cast("int").alias("lots"))
    lots = spread_broadcast(lots)
    asked = asked.join(lots, ["cell", "piece"]).withColumn("lot", F.pmod(hash32(F.col("key"), seed, "lot"), F.col("lots")).cast("int"))
    there = rows.join(lots, ["cell", "piece"]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    near_type = pa.list_(pa.struct([("d", pa.float64()), ("key", pa.string()), ("y", pa.int32())]))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names_out, near = [], []
        if left.num_rows and right.num_rows:
            others, names, ys = _unpacked(right["x"], p), np.asarray(right["key"].to_pylist(), object), right["y"].to_numpy()
            keys, x, bound = np.asarray(left["key"].to_pylist(), object), _unpacked(left["x"], p), left["bound"].to_numpy()
            for a in range(0, len(x), BLOCK):
                places, far = _nearest(x[a : a + BLOCK], keys[a : a + BLOCK], others, names, k)
                for i, (ps, ds) in enumerate(zip(places.tolist(), far.tolist()), a):
                    found = [{"d": d, "key": names[q], "y": int(ys[q])} for q, d in zip(ps, ds) if q >= 0 and d <= bound[i] + EPSILON]
                    if found:
                        names_out.append(keys[i])
                        near.append(found)
        return pa.table({"key": pa.array(names_out, pa.string()), "near": pa.array(near, near_type)})

    found = asked.select("key", "x", "bound", "cell", "piece", "lot").groupBy("cell", "piece", "lot").cogroup(
        there.select("key", "y", "x", "cell", "piece", "lot").groupBy("cell", "piece", "lot")).applyInArrow(search, "key string, near array<struct<d: double, key: string, y: int>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)  # k per searched piece
    everyone = rows.select("key", "y", "x")
    return found.groupBy("key").agg(best.alias("near")).join(everyone.select("key", "y"), "key"), everyone, n


def _unpacked(column, p: int) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), p)
