"""Linear support vector machines for many feature sets and training sets in the same passes.

* ``BatchSquaredHinge``: |w|^2 / 2 + C * sum s_i max(0, 1 - t_i w.x_i)^2, intercept penalised too, classes one-vs-rest.
  Newton steps on the rows inside the margin (the generalised Hessian), each followed by a pass that compares step sizes.
* ``BatchMultiMargin``: the mean over rows of sum_{j != y} max(0, margin - s_y + s_j) / K (for two classes the hinge loss)
  plus decay * |w|^2 / 2 without intercepts; sub-gradients over all rows with adaptive steps, the later iterates averaged.

A pass sums arrays of the models' size over all rows (``BatchLogistic``); nothing else leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .batch_logistic import BatchLogistic, Problem

STEP_SIZES = (1.0, 0.5, 0.25, 0.1, 0.02)


def _own(x: np.ndarray, member: np.ndarray, problem: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the problem's training set, their features and a 1)."""
    mine = (member >> problem[1]) & 1 == 1
    return mine, np.column_stack([x[mine][:, problem[0]], np.ones(int(mine.sum()))])


def _signs(y: np.ndarray, head: int, heads: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(target sign, class weight) per row of a head's problem."""
    target = y == (1 if heads == 1 else head)
    # two classes: each by its weight; one-vs-rest: only the positives are reweighted
    return np.where(target, 1.0, -1.0), weights[y] if heads == 1 else np.where(target, weights[head], 1.0)


class BatchSquaredHinge(BatchLogistic):
    """Fits like ``BatchLogistic``, with the squared hinge loss."""

    def fit(self, problems: Sequence[Problem], start: list[np.ndarray] | None = None, steps: int = 60, tol: float = 1e-8) -> list[np.ndarray]:
        """Weights [heads, features + 1] per problem, intercept last; gradients end below ``tol`` of those at zero."""
        self._class_weights([q.rows for q in problems])
        w = [np.zeros((self.heads, len(q.features) + 1)) if start is None else start[i].copy() for i, q in enumerate(problems)]
        active, first = [(i, h) for i in range(len(problems)) for h in range(self.heads)], {}
        heads, class_w, c = self.heads, dict(self._weights), self.c
        for _ in range(steps):
            todo = [(problems[i].features, problems[i].rows, h, w[i][h]) for i, h in active]

            def slopes(x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
                out = []
                for q in todo:
                    mine, xs = _own(x, member, q)
                    t, s = _signs(y[mine].astype(int), q[2], heads, class_w[q[1]])
                    z = xs @ q[3]
                    inside = t * z < 1
                    xs, s, gap = xs[inside], 2 * c * s[inside], (z - t)[inside]
                    out.append(np.concatenate([xs.T @ (s * gap), (xs.T @ (xs * s[:, None])).ravel()]))
                return np.concatenate(out)

            flat, at, moves = self._sum_over(sum((len(q[0]) + 1) * (len(q[0]) + 2) for q in todo), slopes), 0, {}
            for i, h in active:
                d = len(problems[i].features) + 1
                grad, hess = flat[at : at + d] + w[i][h], flat[at + d : at + d + d * d].reshape(d, d) + np.eye(d)
                at += d + d * d
                norm = float(np.linalg.norm(grad))
                if norm > tol * max(1.0, first.setdefault((i, h), norm)):
                    moves[i, h] = -np.linalg.solve(hess, grad)
            active = list(moves)
            if not active:
                return w
            tried = [(problems[i].features, problems[i].rows, h, [w[i][h] + a * moves[i, h] for a in (0.0, *STEP_SIZES)]) for i, h in active]

            def values(x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
                out = []
                for q in tried:
                    mine, xs = _own(x, member, q)
                    t, s = _signs(y[mine].astype(int), q[2], heads, class_w[q[1]])
                    out += [c * (s * np.maximum(0.0, 1 - t * (xs @ v)) ** 2).sum() for v in q[3]]
                return np.asarray(out)

            loss = self._sum_over(len(tried) * (len(STEP_SIZES) + 1), values).reshape(len(tried), -1)
            still = []
            for (i, h), q, own in zip(active, tried, loss):
                whole = own + [v @ v / 2 for v in q[3]]
                best = int(whole.argmin())
                if best:  # else the objective is flat to the last digit
                    w[i][h] = q[3][best]
                    still.append((i, h))
            active = still
            if not active:
                return w
        return w


class BatchMultiMargin(BatchLogistic):
    """Fits like ``BatchLogistic``, with the multi-margin loss; rows are not weighted."""

    margin, decay, rate = 1.0, 1e-4, 0.3

    def fit(self, problems: Sequence[Problem], start: list[np.ndarray] | None = None, steps: int = 150, tol: float = 0.0) -> list[np.ndarray]:
        w = [np.zeros((self.heads, len(q.features) + 1)) if start is None else start[i].copy() for i, q in enumerate(problems)]
        mean, square = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        kept, heads, margin = [np.zeros_like(x) for x in w], self.heads, self.margin
        size = sum(x.size + 1 for x in w)
        for step in range(1, steps + 1):
            todo = [(q.features, q.rows, w[i]) for i, q in enumerate(problems)]

            def slopes(x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
                out = []
                for q in todo:
                    mine, xs = _own(x, member, q)
                    push, _loss = margin_slopes(xs @ q[2].T, y[mine].astype(int), margin, heads)
                    out.append(np.concatenate([(push.T @ xs).ravel(), [len(xs)]]))
                return np.concatenate(out)

            flat, at = self._sum_over(size, slopes), 0
            for i in range(len(w)):
                g = flat[at : at + w[i].size].reshape(w[i].shape) / max(1.0, flat[at + w[i].size])
                at += w[i].size + 1
                g[:, :-1] += self.decay * w[i][:, :-1]
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                w[i] = w[i] - self.rate / step**0.5 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-12)
                if step > steps // 2:
                    kept[i] += w[i] / (steps - steps // 2)
        return kept

    def losses(self, problems: Sequence[Problem], weights: Sequence[np.ndarray]) -> np.ndarray:
        """The objective of each problem on its training rows."""
        todo, heads, margin = [(q.features, q.rows, v) for q, v in zip(problems, weights)], self.heads, self.margin

        def work(x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
            out = []
            for q in todo:
                mine, xs = _own(x, member, q)
                out += [margin_slopes(xs @ q[2].T, y[mine].astype(int), margin, heads)[1], len(xs)]
            return np.asarray(out, float)

        found = self._sum_over(2 * len(todo), work).reshape(-1, 2)
        return found[:, 0] / np.maximum(found[:, 1], 1) + [self.decay / 2 * (v[:, :-1] ** 2).sum() for v in weights]


def margin_slopes(z: np.ndarray, y: np.ndarray, margin: float, heads: int) -> tuple[np.ndarray, float]:
    """(sub-gradient by score, summed loss) of the multi-margin loss; of the hinge loss for one head."""
    if heads == 1:
        t = np.where(y > 0, 1.0, -1.0)
        gap = margin - t * z[:, 0]
        return np.where(gap > 0, -t, 0.0)[:, None], float(np.maximum(gap, 0).sum())
    rows = np.arange(len(y))
    gap = margin + z - z[rows, y][:, None]
    gap[rows, y] = 0.0
    push = (gap > 0) / heads
    push[rows, y] = -push.sum(axis=1)
    return push, float(np.maximum(gap, 0).sum() / heads)


SVMS = {"linear_svm": BatchSquaredHinge, "multi_margin_svm": BatchMultiMargin}


@dataclass
class LinearModel:
    """``transform`` adds the class with the greatest score, by column expressions only."""

    features: list[str]
    weights: np.ndarray  # [heads, features + 1]

    def transform(self, df: DataFrame) -> DataFrame:
        scores = [sum((F.col(f"`{c}`") * float(v) for c, v in zip(self.features, w[:-1])), F.lit(float(w[-1]))) for w in self.weights]
        if len(scores) == 1:
            return df.select("*", (scores[0] > 0).cast("double").alias("prediction"))
        every = F.array(*scores)
        return df.select("*", (F.array_position(every, F.array_max(every)) - 1).cast("double").alias("prediction"))
