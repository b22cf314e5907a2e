"""Operator 11: embedding whitening by Chebyshev-filtered subspace iteration.

Entries become integers, so sums and means are exact. The leading eigenvectors of the covariance V come from a block of
vectors Q that is multiplied by V in passes over the table: every task sums its rows' part of (X'X)Q with X centred
first, and only arrays of the block's size leave it. A Chebyshev polynomial of V, built by its three-term recurrence,
damps the unwanted part of the spectrum; then QR and Rayleigh-Ritz turn the block into estimates. This repeats until the
residuals of all wanted components are at rounding level. A Lanczos vector that rides along as one more column bounds the
spectrum from below, without passes of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import drop_worker_cache, stored

COMPONENTS, OVERSAMPLED, DEGREE, MAX_ROUNDS = 32, 16, 12, 60
TOLERANCE = 4e-14  # residual norm against the largest eigenvalue
CONTRAST = 1e6  # what one filter may do to the first wanted component against the last
NO_VARIANCE = 1e-11  # eigenvalue against the largest one
SCALE, SHIFT = 64, 1_000_000
PARTIALS_BYTES = 32_000_000  # partial sums the driver takes at once
BATCH_ROWS = 4096


def integer_vectors(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x: floor(scale * entry) + shift of every entry.

    Rows whose vector is null or has null or non-finite entries are dropped, and those whose length is not the commonest
    one (ties: the longer); vectors without entries count as dropped, too.
    """
    finite = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("_v")).filter(
        "_v is not null and size(_v) > 0 and not exists(_v, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    widths = finite.groupBy(F.size("_v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = widths[0]["width"] if widths else 0
    return finite.filter(F.size("_v") == width).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("_v", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift)).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


class Passes:
    """Sums over all rows of a stored table of integer vectors."""

    def __init__(self, table: DataFrame, width: int):
        self.table, self.width = table.select("x"), width
        self.parts = max(1, self.table.rdd.getNumPartitions())
        self.n, self.floor, self.rest = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)

    def total(self, work: Callable[[np.ndarray], np.ndarray], size: int, kind: type = np.float64) -> np.ndarray:
        """The sum of ``work(x)``, flat arrays of ``size`` entries, over batches of all rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            drop_worker_cache()
            sums = np.zeros(size, kind)
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    sums += work(_matrix(batch.slice(at, BATCH_ROWS)))
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "sums": [sums.tobytes()]}, schema=schema)

        def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in b.to_pylist()]
            if rows:
                rows.sort(key=lambda r: r["part"])
                sums = np.zeros(size, kind)
                for r in rows:
                    sums += np.frombuffer(r["sums"], kind)
                yield pa.RecordBatch.from_pydict({"part": [rows[0]["part"]], "sums": [sums.tobytes()]}, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("sums", pa.binary())])
        found, parts = self.table.mapInArrow(run, "part int, sums binary"), self.parts
        while parts > 16 and parts * size * 8 > PARTIALS_BYTES:  # a tree, so that the driver's share stays small
            groups = math.ceil(math.sqrt(parts))
            found = found.repartition(groups, F.pmod("part", F.lit(groups))).mapInArrow(fewer, "part int, sums binary")
            parts = groups
        out = np.zeros(size, kind)
        for row in sorted(found.collect(), key=lambda r: r["part"]):
            out += np.frombuffer(row["sums"], kind)
        return out

    def center(self) -> None:
        """Exact sums: n and the mean of every dimension as a whole part and a rest over n."""
        width = self.width

        def halves(x: np.ndarray) -> np.ndarray:  # two sums that cannot overflow below 2**31 rows a task
            return np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

        found = [int(v) for v in self.total(halves, 2 * width + 1, np.int64)]
        self.n = found[0]
        self.sums = [(a << 32) + b for a, b in zip(found[1 : width + 1], found[width + 1 :])]
        if self.n:
            self.floor = np.asarray([s // self.n for s in self.sums], np.int64)
            self.rest = np.asarray([s % self.n for s in self.sums], np.int64)

    def centered(self) -> Callable[[np.ndarray], np.ndarray]:
        floor, share = self.floor, self.rest / max(self.n, 1)
        return lambda x: (x - floor) - share

    def times(self, block: np.ndarray) -> np.ndarray:
        """V @ block."""
        center, shape = self.centered(), block.shape

        def work(x: np.ndarray) -> np.ndarray:
            c = center(x)
            return (c.T @ (c @ block)).ravel()

        return self.total(work, block.size).reshape(shape) / self.n

    def trace(self) -> float:
        center = self.centered()
        return float(self.total(lambda x: np.atleast_1d((center(x) ** 2).sum()), 1)[0]) / self.n


class Lanczos:
    """A bound below the spectrum from a few products of V with single vectors."""

    def __init__(self, width: int, rng: np.random.Generator):
        v = rng.normal(size=width)
        self.basis, self.alpha, self.beta = [v / np.linalg.norm(v)], [], []

    @property
    def vector(self) -> np.ndarray:
        return self.basis[-1]

    def take(self, product: np.ndarray) -> None:
        if self.beta and self.beta[-1] == 0.0:  # the vectors span an invariant space
            return
        self.alpha.append(float(self.vector @ product))
        rest = product.copy()
        for _ in range(2):
            for b in self.basis:
                rest -= (b @ rest) * b
        norm = float(np.linalg.norm(rest))
        done = len(self.basis) == len(product) or norm <= 1e-12 * abs(self.alpha[0])
        self.beta.append(0.0 if done else norm)
        if not done:
            self.basis.append(rest / norm)

    def floor(self) -> float:
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.beta[-1])


def filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, product: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of V for [low, high] times ``block``, one at ``top``; ``product`` is V @ block."""
    middle, half = (low + high) / 2, (high - low) / 2
    first = half / (top - middle)
    sigma, before, now = first, block, (product - middle * block) * (first / half)
    for _ in range(degree - 1):
        next_sigma = 1.0 / (2.0 / first - sigma)
        before, now = now, (times(now) - middle * now) * (2.0 * next_sigma / half) - (sigma * next_sigma) * before
        sigma = next_sigma
    return now


def _chebyshev(t: float, degree: int) -> float:
    return math.cosh(degree * math.acosh(t)) if t < 1e30 / degree and degree * math.acosh(max(t, 1.0)) < 700 else math.inf


def _degree(low: float, high: float, top: float, last: float, most: int) -> int:
    """The largest degree that keeps what it does to ``top`` and ``last`` within ``CONTRAST`` of each other."""
    middle, half = (low + high) / 2, (high - low) / 2
    at = [max(1.0, (v - middle) / half) for v in (top, last)]
    return max([1, *(m for m in range(2, most + 1) if _chebyshev(at[0], m) <= CONTRAST * _chebyshev(at[1], m))])


def leading(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, seed: int = 42, oversampled: int = OVERSAMPLED, degree: int = DEGREE, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, dict]:
    """(eigenvalues falling, unit eigenvectors as columns, certificate) of the ``wanted`` leading pairs of V >= 0.

    A pair is certified when its residual is below ``tolerance`` of the largest eigenvalue. Certified leading pairs leave
    the block; products are kept orthogonal to them, so a dominating eigenvalue does not drown the others.
    """
    wanted = min(wanted, width)
    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.normal(size=(width, min(width, wanted + oversampled))))[0]
    lanczos, passes, worst, scale = Lanczos(width, rng), 0, 0.0, 0.0
    held, values_held = np.zeros((width, 0)), np.zeros(0)

    def away(b: np.ndarray) -> np.ndarray:
        return b - held @ (held.T @ b)

    def product_of(b: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        out = times(np.column_stack([b, lanczos.vector]))
        lanczos.take(out[:, -1])
        return away(out[:, :-1])

    for round_ in range(1, MAX_ROUNDS + 1):
        product = product_of(block)
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        scale = max(scale, float(values[0]))
        residuals = np.linalg.norm(product - block * values, axis=0)
        left = wanted - len(values_held)
        open_ = np.flatnonzero(residuals[:left] > tolerance * scale)
        done = int(open_[0]) if len(open_) else left
        worst = max([worst, *residuals[:done]])
        held, values_held = np.column_stack([held, block[:, :done]]), np.concatenate([values_held, values[:done]])
        if done == left:
            order = np.argsort(-values_held, kind="stable")
            return values_held[order], held[:, order], {"rounds": round_, "passes": passes, "residual": float(worst / scale) if scale else 0.0}
        block, product, values = block[:, done:], product[:, done:], values[done:]
        high = float(values[-1])
        low = min(lanczos.floor(), 0.95 * high)
        if high > NO_VARIANCE * scale:
            m = _degree(low, high, float(values[0]), float(values[left - done - 1]), degree)
            product = filtered(product_of, block, product, low, high, float(values[0]), m)
        # else the block holds all of V's range after this product
        block = np.linalg.qr(away(np.linalg.qr(away(product))[0]))[0]
    raise ArithmeticError(f"{wanted - len(values_held)} leading components are not certified after {MAX_ROUNDS} rounds: residual {residuals.max() / scale:.2g}")


@dataclass
class Whitening:
    """A fitted whitening: exact means, components as columns, eigenvalues, and how far the result is from white."""

    n: int
    floor: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float
    certificate: dict


def fit(vectors: DataFrame, components: int = COMPONENTS, seed: int = 42) -> Whitening | None:
    """Fit on a stored table of ``integer_vectors``; None without rows. Components without variance are left out."""
    head = vectors.select(F.size("x").alias("w")).limit(1).collect()
    if not head:
        return None
    passes = Passes(vectors, head[0]["w"])
    passes.center()
    values, found, certificate = leading(passes.times, passes.width, components, seed)
    kept = values > NO_VARIANCE * max(float(values[0]), 0.0)
    values, found = values[kept], found[:, kept]
    k = len(values)
    if not k:
        return Whitening(passes.n, passes.floor, passes.rest, values, found, 0.0, 0.0, certificate)
    center, unit = passes.centered(), found / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = center(x) @ unit
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    sums = passes.total(moments, k + k * k)
    mean = sums[:k] / passes.n
    error = np.abs(sums[k:].reshape(k, k) / passes.n - np.outer(mean, mean) - np.eye(k)).max()
    return Whitening(passes.n, passes.floor, passes.rest, values, found, passes.trace(), float(error), certificate)


def _deviations(x: np.ndarray, n: int, floor: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Per row the exact sum over dimensions of (n * x - S)^2."""
    gaps = x - floor
    largest = n * (int(np.abs(gaps).max()) + 1)
    if largest * largest * x.shape[1] < 2**63:
        return ((n * gaps - rest) ** 2).sum(1)
    exact = [sum((n * int(g) - int(r)) ** 2 for g, r in zip(row, rest)) for row in gaps]
    if max(exact) >= 2**63:
        raise OverflowError("a deviation does not fit into 64 bits")
    return np.asarray(exact, np.int64)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    k, share = len(model.values), model.rest / max(model.n, 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                x, m = _matrix(batch), batch.num_rows
                w = (((x - model.floor) - share) @ model.components) / np.sqrt(model.values)
                columns = [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n), np.repeat(_deviations(x, model.n, model.floor, model.rest), k),
                           w.ravel(), np.tile(model.values / model.trace, m), np.full(m * k, model.identity_error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    table = vectors.select("vec_id", "x")
    return (table if k else table.limit(0)).mapInArrow(rows, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened_rows(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``rows`` (vec_id, embedding) fitted and whitened.

    Dropped: see ``integer_vectors``. Every other row takes part once for each time it stands in the table, also under a
    null or repeated vec_id; equal vectors have equal results. Fewer dimensions than ``components`` give as many as
    there are; components without variance (all of them for a single vector) have no rows, so an empty table or one of
    equal vectors gives none. Equal eigenvalues leave the choice of their vectors open; it is the same for all rows.
    Other columns are not read, whatever their names. Entries too large for an exact 64-bit deviation raise.
    """
    vectors = stored(integer_vectors(rows), "vectors")
    model = fit(vectors, components)
    if model is None:
        model = Whitening(0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, {})
    return whiten(vectors, model)


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
