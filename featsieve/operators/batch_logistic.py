"""Many class-balanced, L2-penalised logistic regressions fitted by the same passes over the data.

Wrapper and search rankers compare dozens of feature subsets. Fitting them one
by one costs one job chain each; here every Newton step of all subsets is one
pass that sums gradients and Hessians, and all subsets are scored by one pass.
Only matrices of the size of the models travel. Many subsets of the same rows are one matrix product: their
Hessians are weighted sums of the same products of two columns.

Objective per subset and class: |w|^2 / 2 + C * sum s_i log(1 + exp(-t_i w.x_i)),
intercept penalised too; more than two classes are handled one-vs-rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


PRODUCT_CELLS = 1_000_000  # products of two columns, or scores of all subsets, that a task holds at once
SHARED_HEADS, SHARED_COLUMNS = 8, 40  # subsets times classes from which, and columns up to which, products of columns are shared


def packed(data: DataFrame, p: int) -> DataFrame:
    """x, y, member as blocks of rows, which a pass reads without converting each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({
                    "x": [b.column("x").flatten().to_numpy(zero_copy_only=False).tobytes()], "y": [b.column("y").to_numpy().astype(np.int32).tobytes()],
                    "member": [b.column("member").to_numpy().astype(np.int64).tobytes()]})

    return data.select("x", "y", "member").mapInArrow(run, "x binary, y binary, member binary")


@dataclass
class Problem:
    """A feature subset (positions) trained on the rows whose ``member`` bit ``rows`` is set."""

    features: tuple[int, ...]
    rows: int = 0


class BatchLogistic:
    """``data`` has x: array<double>, y: int code, member: bigint bit set; or blocks of them (``packed``)."""

    def __init__(self, data: DataFrame, n_classes: int, n_features: int, penalty_c: float = 1.0):
        self.data, self.k, self.p, self.c = data.select("x", "y", "member"), n_classes, n_features, penalty_c
        self.heads = 1 if n_classes == 2 else n_classes
        self._weights: dict[int, np.ndarray] = {}
        self._packed = data.schema["x"].dataType.typeName() == "binary"

    def _sum_over(self, size: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of ``work(x, y, member)`` vectors over all batches of rows."""
        p, blocks = self.p, self._packed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                if blocks:
                    for x, y, member in zip(*b.columns):
                        total += work(np.frombuffer(x.as_buffer()).reshape(-1, p), np.frombuffer(y.as_buffer(), np.int32), np.frombuffer(member.as_buffer(), np.int64))
                elif b.num_rows:
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                    total += work(x, b.column("y").to_numpy(), b.column("member").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = self.data.mapInArrow(run, "part binary")
        return parts.rdd.map(lambda r: np.frombuffer(bytes(r[0]))).treeReduce(np.add)

    def _class_weights(self, bits: Sequence[int]) -> None:
        """Balanced weights of each training row set that is not known yet."""
        new = sorted(set(bits) - set(self._weights))
        if not new:
            return
        k = self.k

        def count(x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
            return np.concatenate([np.bincount(y[(member >> b) & 1 == 1], minlength=k) for b in new]).astype(float)

        for b, n in zip(new, self._sum_over(len(new) * k, count).reshape(-1, k)):
            self._weights[b] = n.sum() / (k * np.maximum(n, 1))

    def fit(self, problems: Sequence[Problem], start: list[np.ndarray] | None = None, steps: int = 20, tol: float = 1e-5) -> list[np.ndarray]:
        """Weights [heads, features + 1] per problem, intercept last."""
        self._class_weights([q.rows for q in problems])
        w = [np.zeros((self.heads, len(q.features) + 1)) if start is None else start[i].copy() for i, q in enumerate(problems)]
        active = list(range(len(problems)))
        k, heads, c, class_w = self.k, self.heads, self.c, dict(self._weights)
        for _ in range(steps):
            if not active:
                break
            todo = [(problems[i].features, problems[i].rows, w[i]) for i in active]
            sizes = [heads * (len(f) + 1) * (len(f) + 2) for f, _b, _w in todo]

            shared = len(todo) * heads >= SHARED_HEADS and self.p <= SHARED_COLUMNS

            def work(x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
                if shared:
                    return _shared_sums(todo, heads, c, class_w, x, y, member)
                out = []
                for feats, bit, weights in todo:
                    mine = (member >> bit) & 1 == 1
                    xs, ys = np.column_stack([x[mine][:, feats], np.ones(mine.sum())]), y[mine].astype(int)
                    for h in range(heads):
                        target = ys == (1 if heads == 1 else h)
                        # two classes: each by its weight; one-vs-rest: only the positives are reweighted
                        s = c * (class_w[bit][ys] if heads == 1 else np.where(target, class_w[bit][h], 1.0))
                        prob = 1.0 / (1.0 + np.exp(-np.clip(xs @ weights[h], -35, 35)))
                        out.append(np.concatenate([xs.T @ (s * (prob - target)), (xs.T @ (xs * (s * prob * (1 - prob))[:, None])).ravel()]))
                return np.concatenate(out)

            flat, at, still = self._sum_over(sum(sizes), work), 0, []
            for i in active:
                d, moved = len(problems[i].features) + 1, 0.0
                for h in range(heads):
                    grad = flat[at:at + d] + w[i][h]
                    hess = flat[at + d:at + d + d * d].reshape(d, d) + np.eye(d)
                    at += d + d * d
                    step = np.linalg.solve(hess, grad)
                    w[i][h] -= step
                    moved = max(moved, float(np.abs(step).max()))
                if moved > tol:
                    still.append(i)
            active = still
        return w

    def confusion(self, problems: Sequence[Problem], weights: Sequence[np.ndarray]) -> np.ndarray:
        """Counts [problem, y, prediction] on the rows outside each problem's training set."""
        k, heads = self.k, self.heads
        todo = [(q.features, q.rows, w) for q, w in zip(problems, weights)]

        def work(x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
            out, held = np.zeros((len(todo), k * k)), {}
            for j, (feats, bit, w) in enumerate(todo):
                if bit not in held:
                    own = np.flatnonzero((member >> bit) & 1 == 0)
                    held[bit] = x[own], y[own].astype(int) * k
                xs, base = held[bit]
                z = xs[:, feats] @ w[:, :-1].T + w[:, -1]
                pred = (z[:, 0] > 0).astype(int) if heads == 1 else z.argmax(axis=1)
                out[j] = np.bincount(base + pred, minlength=k * k)
            return out.ravel()

        return self._sum_over(len(todo) * k * k, work).reshape(len(todo), k, k)


def _shared_sums(todo: Sequence[tuple], heads: int, c: float, class_w: dict[int, np.ndarray], x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of every (features, row set, weights), one after the other, per head."""
    out: list = [None] * len(todo)
    d = x.shape[1] + 1
    i, j = np.triu_indices(d)
    pair = np.zeros((d, d), int)
    pair[i, j] = pair[j, i] = np.arange(len(i))
    for bit in dict.fromkeys(b for _f, b, _w in todo):
        which = [t for t, q in enumerate(todo) if q[1] == bit]
        places = [[*todo[t][0], d - 1] for t in which]
        w = np.zeros((d, len(which) * heads))
        for n, (t, own) in enumerate(zip(which, places)):
            w[own, n * heads : (n + 1) * heads] = todo[t][2].T
        mine = np.flatnonzero((member >> bit) & 1)
        slope, curve = np.zeros(w.shape), np.zeros((len(i), w.shape[1]))
        step = max(64, PRODUCT_CELLS // 8 // max(len(i), w.shape[1]))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            xs, ys = np.column_stack([x[rows], np.ones(len(rows))]), y[rows].astype(int)
            target = (ys == 1)[:, None] if heads == 1 else ys[:, None] == np.arange(heads)
            # two classes: each by its weight; one-vs-rest: only the positives are reweighted
            s = np.tile(c * (class_w[bit][ys][:, None] if heads == 1 else np.where(target, class_w[bit], 1.0)), len(which))
            prob = np.clip(xs @ w, -35, 35)
            np.negative(prob, out=prob)
            np.exp(prob, out=prob)
            prob += 1.0
            np.reciprocal(prob, out=prob)
            slope += xs.T @ (s * (prob - np.tile(target, len(which))))
            s *= prob
            np.subtract(1.0, prob, out=prob)
            s *= prob
            curve += (xs[:, i] * xs[:, j]).T @ s
        for n, (t, own) in enumerate(zip(which, places)):
            hess = pair[np.ix_(own, own)].ravel()
            out[t] = np.concatenate([np.concatenate([slope[own, h], curve[hess, h]]) for h in range(n * heads, (n + 1) * heads)])
    return np.concatenate(out)


def weighted_f1(confusion: np.ndarray) -> float:
    """Support-weighted F1 of one confusion matrix [y, prediction]."""
    tp, support, predicted = np.diag(confusion), confusion.sum(axis=1), confusion.sum(axis=0)
    f1 = 2 * tp / np.maximum(support + predicted, 1)
    return float((f1 * support).sum() / max(support.sum(), 1))
