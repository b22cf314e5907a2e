"""Columns as bin codes in row blocks, and draws that depend on keys alone: the input of the tree ensembles.

A block is one record with the codes of up to ``BLOCK_ROWS`` rows, so a pass over the table costs little outside numpy.
Bin edges come from the rows with the smallest key hashes (all rows of a small table); every row is coded and used.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MAX_BINS = 64
BLOCK_ROWS = 16_384
SAMPLE_CELLS = 5_000_000  # values the edges are taken from, over all columns
BLOCK_SCHEMA = "n int, codes binary, y binary, id binary, member binary, held binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(ids: np.ndarray, *salts: int) -> np.ndarray:
    """64 hashed bits per id."""
    state = np.zeros(1, np.uint64)
    for s in salts:
        state = _mix(state + np.uint64(0x9E3779B97F4A7C15) + np.uint64(s & 0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        return _mix(_mix(ids.astype(np.uint64) + state))


def draws(ids: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers in [0, 1) per id."""
    return (salted(ids, *salts) >> np.uint64(11)) * 2.0**-53


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 18)])))


def bootstrap_counts(ids: np.ndarray, *salts: int) -> np.ndarray:
    """How often each row is drawn: Poisson with mean 1."""
    return np.searchsorted(_POISSON, draws(ids, *salts), side="right")


def edges_of(values: np.ndarray, bins: int = MAX_BINS) -> np.ndarray:
    """Upper bounds of all bins but the last: midpoints of few distinct values, else quantiles."""
    v = np.sort(values[np.isfinite(values)])
    distinct = np.unique(v)
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) / 2
    cuts = np.unique(v[np.arange(1, bins) * len(v) // bins])
    return cuts[cuts < distinct[-1]]


@dataclass
class Blocks:
    """Binned rows: member and held are bit sets, a bit for each model the row is fitted or judged by."""

    data: DataFrame
    edges: list[np.ndarray]
    rows: int
    classes: int

    @property
    def bins(self) -> int:
        return max([len(e) for e in self.edges], default=0) + 1

    def release(self) -> None:
        self.data.unpersist()


def code_columns(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin codes [rows, columns]; missing values are in the last bin."""
    return np.column_stack([np.searchsorted(e, c, side="left").astype(np.uint8) for c, e in zip(columns, edges)])


def number_columns(features: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]


def fit_edges(df: DataFrame, key: str, features: Sequence[str], rows: int) -> list[np.ndarray]:
    share = min(1.0, SAMPLE_CELLS / max(1, len(features)) / max(1, rows))
    small = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    sample = df.filter(small).select(*number_columns(features)).toPandas()  # SAMPLE_CELLS values at most, in expectation
    return [edges_of(sample[f"f{i}"].to_numpy(float)) for i in range(len(features))]


def to_blocks(
    df: DataFrame, label: str, key: str, features: Sequence[str], classes: int, member: Column | None = None, held: Column | None = None,
    edges: list[np.ndarray] | None = None,
) -> Blocks:
    """Bin ``features`` of every row; ``label`` holds class numbers from 0, ``key`` is unique."""
    rows = df.count()
    edges = fit_edges(df, key, features, rows) if edges is None else edges
    p = len(features)
    everyone = F.lit(1) if member is None else member
    plain = df.select(
        F.col(label).cast("int").alias("y"), F.xxhash64(F.col(key).cast("string")).alias("id"), everyone.cast("bigint").alias("member"),
        (F.lit(0) if held is None else held).cast("bigint").alias("held"), *number_columns(features))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(at, BLOCK_ROWS)
                codes = code_columns([b.column(4 + i).to_numpy(zero_copy_only=False) for i in range(p)], edges)
                head = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                kinds = (np.int32, np.int64, np.int64, np.int64)
                yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int32()), "codes": [codes.tobytes()], **{c: [h.astype(t).tobytes()] for c, h, t in zip(("y", "id", "member", "held"), head, kinds)}})

    return Blocks(plain.mapInArrow(blocks, BLOCK_SCHEMA).persist(), edges, rows, classes)


def block_rows(row: dict, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, y, ids, member, held) of one block."""
    n = row["n"]
    return (np.frombuffer(row["codes"], np.uint8).reshape(n, p), np.frombuffer(row["y"], np.int32), np.frombuffer(row["id"], np.int64).view(np.uint64),
            np.frombuffer(row["member"], np.int64), np.frombuffer(row["held"], np.int64))
