"""Second-order gradient boosting on binned columns, all classes of a round together.

At every level of a round tasks sum gradients and Hessians by (class, node, feature, bin), and only splits or sums of a
model's size leave them. Gradients and Hessians are rounded to whole numbers first, so sums do not depend on their order:
the same table gives the same trees under any partitioning.

A level is a pass over the blocks; large sums meet by node in tasks. Scores of a block are kept by the worker that made
them; a worker that does not have them, or only those of an earlier round, makes them from the trees. At most
``LOCAL_ROWS`` rows of ``LOCAL_CELLS`` codes are one task's work: it grows all rounds at once, as a pass costs more than
to count them. It counts the smaller child of each split alone and takes the other from the parent. Both ways give the
same trees.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .binned import Blocks, block_rows, draws

FIXED = float(1 << 24)  # gradients and Hessians are counted in parts of this size
COLLECTED_BYTES = 16_000_000  # sums of all tasks that one place takes at a level; larger ones meet by node in tasks
LOCAL_ROWS = 2_000_000  # rows one task boosts alone, in about 0.2 s a round; passes take longer up to here
LOCAL_CELLS = 40_000_000  # their codes, a byte each
KEPT_BYTES = 128_000_000  # scores a worker keeps

_kept: dict = {"model": None, "bytes": 0, "scores": {}}


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    balanced: bool = False
    seed: int = 42


@dataclass
class BoostTree:
    """A tree in heap order: children of node i are 2i + 1 and 2i + 2; feature -1 is a leaf (or nothing)."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> BoostTree:
        size = (1 << (depth + 1)) - 1
        return BoostTree(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))

    def route(self, codes: np.ndarray, levels: int) -> np.ndarray:
        at, every = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(levels):
            f = self.feature[at]
            go = 2 * at + 1 + (codes[every, np.maximum(f, 0)] > self.bin[at])
            at = np.where(f >= 0, go, at)
        return at


@dataclass
class Boosted:
    """Rounds of trees, one per head, with the gain and number of splits per feature."""

    classes: int
    depth: int
    columns: int
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    trees: list[list[BoostTree]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.gain, self.splits = np.zeros(self.columns), np.zeros(self.columns)

    @property
    def heads(self) -> int:
        return 1 if self.classes == 2 else self.classes

    def add(self, scores: np.ndarray, codes: np.ndarray, first: int) -> np.ndarray:
        """``scores`` of the first rounds with the later ones added."""
        for round_ in self.trees[first:]:
            for head, tree in enumerate(round_):
                scores[:, head] += tree.value[tree.route(codes, self.depth)]
        return scores

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """Class probabilities; one column for two classes."""
        if self.heads == 1:
            return 1.0 / (1.0 + np.exp(-scores))
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def kept_scores(model: Boosted, name: bytes, codes: np.ndarray) -> np.ndarray:
    """Scores of a block after all rounds of ``model``, from what this worker has of them."""
    if _kept["model"] != model.name:
        _kept.update(model=model.name, bytes=0, scores={})
    rounds, scores = _kept["scores"].get(name, (0, None))
    fresh = scores is None
    scores = model.add(np.zeros((len(codes), model.heads)) if fresh else scores, codes, rounds)
    if fresh and _kept["bytes"] + scores.nbytes <= KEPT_BYTES:
        _kept["bytes"] += scores.nbytes
        fresh = False
    if not fresh:
        _kept["scores"][name] = (len(model.trees), scores)
    return scores


def gradients(model: Boosted, scores: np.ndarray, y: np.ndarray, class_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian) [row, head] in whole parts of ``FIXED``."""
    chance = model.chances(scores)
    target = (y[:, None] == 1) if model.heads == 1 else (y[:, None] == np.arange(model.heads))
    w = class_weight[y][:, None]
    factor = 1.0 if model.heads == 1 else 2.0  # the softmax Hessian's usual bound
    return np.rint(w * (chance - target) * FIXED), np.rint(w * factor * np.maximum(chance * (1 - chance), 1e-16) * FIXED)


def node_sums(codes: np.ndarray, node: np.ndarray, nodes: int, columns: np.ndarray, bins: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """[node, column, bin, (gradient, Hessian, rows)] as whole numbers."""
    m = len(columns)
    at = ((node[:, None] * m + np.arange(m)) * bins + codes[:, columns]).ravel()
    out = np.empty((nodes * m * bins, 3), np.int64)
    for i, w in enumerate((g, h, None)):
        out[:, i] = np.bincount(at, weights=None if w is None else np.repeat(w, m), minlength=len(out))
    return out.reshape(nodes, m, bins, 3)


def gain_splits(sums: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(column place, bin, gain, leaf value) of every node; the gain is -inf where nothing may be split."""
    totals = sums[:, 0].sum(axis=1) / np.asarray([FIXED, FIXED, 1.0])
    value = -totals[:, 0] / (totals[:, 1] + s.l2) * s.rate
    left = np.cumsum(sums, axis=2)[:, :, :-1] / np.asarray([FIXED, FIXED, 1.0])
    if not left.shape[2]:
        return np.zeros(len(sums), int), np.zeros(len(sums), int), np.full(len(sums), -np.inf), value
    right = totals[:, None, None] - left
    gain = left[..., 0] ** 2 / (left[..., 1] + s.l2) + right[..., 0] ** 2 / (right[..., 1] + s.l2) - (totals[:, 0] ** 2 / (totals[:, 1] + s.l2))[:, None, None]
    ok = (np.minimum(left[..., 1], right[..., 1]) >= s.min_hessian) & (np.minimum(left[..., 2], right[..., 2]) >= s.min_rows) & (gain > 1e-9)
    flat = np.where(ok, gain, -np.inf).reshape(len(sums), -1)
    best = flat.argmax(axis=1)
    return best // gain.shape[2], best % gain.shape[2], flat[np.arange(len(flat)), best], value


def tried_columns(p: int, share: float, seed: int, round_: int, head: int) -> np.ndarray:
    """The columns of a tree."""
    m = max(1, int(p * share))
    return np.sort(np.argsort(draws(np.arange(1, p + 1, dtype=np.uint64), seed, 2, round_, head), kind="stable")[:m])


Found = dict[tuple[int, int], tuple]  # (head, node) -> column place, bin, gain, leaf value


@dataclass
class Level:
    """The open nodes of a level and the shape of their sums per head."""

    number: int
    nodes: dict[int, list[int]]
    columns: list[np.ndarray]
    shapes: dict[int, tuple[int, ...]]

    @property
    def cells(self) -> int:
        return sum(int(np.prod(x)) for x in self.shapes.values())

    def sums(self, trees: list[BoostTree], codes: np.ndarray, g: np.ndarray, hess: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for h, shape in self.shapes.items():
            at = trees[h].route(codes, self.number)
            place = np.full((1 << (self.number + 1)) - 1, -1)
            place[self.nodes[h]] = np.arange(len(self.nodes[h]))
            r = np.flatnonzero(place[at] >= 0)
            out[h] = node_sums(codes[r], place[at[r]], shape[0], self.columns[h], shape[2], g[r, h], hess[r, h])
        return out

    def splits(self, total: np.ndarray, s: Settings) -> Found:
        """Best splits from the flat sums of all heads."""
        out, begin = {}, 0
        for h, shape in self.shapes.items():
            n = int(np.prod(shape))
            for node, *found in zip(self.nodes[h], *gain_splits(total[begin : begin + n].reshape(shape), s)):
                out[h, node] = tuple(found)
            begin += n
        return out


def grow_round(model: Boosted, s: Settings, round_: int, bins: int, find: Callable[[Level, list[BoostTree]], Found]) -> None:
    """Add the trees of a round; ``find`` gives the best splits of a level."""
    columns = [tried_columns(model.columns, s.columns, s.seed, round_, h) for h in range(model.heads)]
    trees = [BoostTree.empty(s.depth) for _ in range(model.heads)]
    open_ = {h: [0] for h in range(model.heads)}
    for number in range(s.depth + 1):
        used = [c[:1] if number == s.depth else c for c in columns]  # the deepest level needs totals only
        level = Level(number, open_, used, {h: (len(nodes), len(used[h]), bins, 3) for h, nodes in open_.items()})
        open_ = {}
        for (h, node), (which, at, gain, value) in sorted(find(level, trees).items()):
            tree = trees[h]
            tree.value[node] = value
            if number < s.depth and gain > -np.inf:
                f = int(columns[h][which])
                tree.feature[node], tree.bin[node] = f, at
                model.gain[f] += gain
                model.splits[f] += 1
                open_.setdefault(h, []).extend((2 * node + 1, 2 * node + 2))
        if not open_:
            break
    model.trees.append(trees)


def boost(blocks: Blocks, settings: Settings, class_weight: np.ndarray | None = None) -> Boosted:
    """Fit on the rows whose ``member`` bit 0 is set."""
    s, p, k = settings, len(blocks.edges), blocks.classes
    model = Boosted(k, s.depth, p)
    weight = np.ones(k) if class_weight is None or not s.balanced else class_weight
    parts = max(1, blocks.data.rdd.getNumPartitions())
    if blocks.rows <= LOCAL_ROWS and blocks.rows * p <= LOCAL_CELLS:
        return _rounds_in_a_task(blocks, model, s, weight)
    for round_ in range(s.rounds):
        grow_round(model, s, round_, blocks.bins, lambda level, trees: _pass(blocks, model, s, weight, round_, level, trees, parts))
    return model


@dataclass
class HeldRows:
    """A round over rows that one task holds: which node each is in, and the sums of the level before."""

    columns: list[np.ndarray]  # codes of each column
    flat: np.ndarray  # codes of each row after the other
    own: np.ndarray | None  # rows the round is fitted on; None: all
    g: np.ndarray
    hess: np.ndarray
    bins: int
    at: list[np.ndarray]  # node of every row, per head
    before: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)  # (head, node) -> sums [column, bin, 3]

    def counted(self, h: int, rows: np.ndarray | None, place: np.ndarray | int, nodes: int, used: np.ndarray) -> np.ndarray:
        take = (lambda x: x) if rows is None else (lambda x: x[rows])
        g, hess, out = take(self.g[:, h]), take(self.hess[:, h]), np.empty((nodes, len(used), self.bins, 3), np.int64)
        for j, c in enumerate(used):
            key = place * self.bins + take(self.columns[c])
            for i, w in enumerate((g, hess, None)):
                out[:, j, :, i] = np.bincount(key, weights=w, minlength=nodes * self.bins).reshape(nodes, self.bins)
        return out

    def descend(self, h: int, tree: BoostTree) -> None:
        """Rows go to the children of the nodes that were split."""
        split = tree.feature >= 0  # nothing is left in those split before
        follow = np.where(split, 2 * np.arange(len(split)) + 1, np.arange(len(split)))
        cut, f, at = np.where(split, tree.bin, 255).astype(np.uint8), np.maximum(tree.feature, 0).astype(np.int64), self.at[h]
        first = np.arange(len(at)) * len(self.columns)
        self.at[h] = follow[at] + (self.flat[first + f[at]] > cut[at])

    def find(self, level: Level, trees: list[BoostTree], s: Settings) -> Found:
        total, now = [], {}
        for h, shape in level.shapes.items():
            nodes, used, tree = level.nodes[h], level.columns[h], trees[h]
            if not level.number:
                sums = self.counted(h, None if self.own is None else np.flatnonzero(self.own), 0, 1, used)
            else:
                self.descend(h, tree)
                sums, small = np.zeros(shape, np.int64), []
                for i in range(0, len(nodes), 2):  # the children of a node
                    parent = (nodes[i] - 1) // 2
                    was, columns = self.before[h, parent]
                    left = was[np.searchsorted(columns, tree.feature[parent]), : tree.bin[parent] + 1].sum(axis=0)
                    whole = was[0].sum(axis=0)
                    if level.number == s.depth:  # totals are all that is needed
                        sums[i, 0, 0], sums[i + 1, 0, 0] = left, whole - left
                    small.append(i + int(2 * left[2] > whole[2]))
                if level.number < s.depth:
                    place = np.full(len(tree.feature), -1)
                    place[[nodes[i] for i in small]] = np.arange(len(small))
                    place = place[self.at[h]]
                    rows = np.flatnonzero(place >= 0 if self.own is None else (place >= 0) & self.own)
                    sums[small] = self.counted(h, rows, place[rows], len(small), used)
                    for i in small:
                        other = i ^ 1
                        sums[other] = self.before[h, (nodes[i] - 1) // 2][0] - sums[i]
            now |= {(h, node): (one, used) for node, one in zip(nodes, sums)}
            total.append(sums.ravel())
        self.before = now
        return level.splits(np.concatenate(total), s)


def _rounds_in_a_task(blocks: Blocks, model: Boosted, s: Settings, weight: np.ndarray) -> Boosted:
    """All rounds on the few rows of ``blocks``."""
    p, bins = len(blocks.edges), blocks.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [block_rows(row, p) for b in batches for row in b.to_pylist()]
        empty = (np.zeros((0, p), np.uint8), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        codes, y, ids, member = (np.concatenate(c) for c in zip(empty, *[x[:4] for x in parts]))
        del parts
        scores, inside = np.zeros((len(y), model.heads)), (member & 1) == 1
        columns, flat = [np.ascontiguousarray(codes[:, j]) for j in range(p)], codes.ravel()
        for round_ in range(s.rounds):
            own = inside if s.rows >= 1 else inside & (draws(ids, s.seed, 1, round_) < s.rows)
            g, hess = gradients(model, scores, y, weight)
            held = HeldRows(columns, flat, None if own.all() else own, np.asfortranarray(g), np.asfortranarray(hess), bins, [np.zeros(len(y), np.int64) for _ in range(model.heads)])
            grow_round(model, s, round_, bins, lambda level, trees: held.find(level, trees, s))
            for h, tree in enumerate(model.trees[-1]):
                scores[:, h] += tree.value[held.at[h]]
        found = ([[(t.feature, t.bin, t.value) for t in r] for r in model.trees], model.gain, model.splits)
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(found)]})

    trees, gain, splits = pickle.loads(blocks.data.repartition(1).mapInArrow(run, "model binary").collect()[0]["model"])
    model.trees, model.gain, model.splits = [[BoostTree(*t) for t in r] for r in trees], gain, splits
    return model


def _pass(blocks: Blocks, model: Boosted, s: Settings, weight: np.ndarray, round_: int, level: Level, trees: list[BoostTree], parts: int) -> Found:
    """Best splits of a level by one pass over the blocks."""
    p = len(blocks.edges)
    meet = level.cells * 8 * parts > COLLECTED_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {h: np.zeros(shape, np.int64) for h, shape in level.shapes.items()}
        for b in batches:
            for row in b.to_pylist():
                codes, y, ids, member, _held = block_rows(row, p)
                scores = kept_scores(model, row["id"], codes)
                own = np.flatnonzero(((member & 1) == 1) & (draws(ids, s.seed, 1, round_) < s.rows))
                g, hess = gradients(model, scores[own], y[own], weight)
                for h, found in level.sums(trees, codes[own], g, hess).items():
                    sums[h] += found
        rows = [(h, node, one) for h, found in sums.items() for node, one in zip(level.nodes[h], found)] if meet else [(-1, -1, np.concatenate([f.ravel() for f in sums.values()]))]
        for h, node, one in rows:
            yield pa.RecordBatch.from_pydict({"head": pa.array([h], pa.int32()), "node": pa.array([node], pa.int32()), "sums": [one.tobytes()]})

    def choose(part: pa.Table) -> pa.Table:
        h, node = part["head"][0].as_py(), part["node"][0].as_py()
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in part["sums"]).reshape(1, *level.shapes[h][1:])
        which, at, gain, value = gain_splits(total, s)
        return pa.table({"head": pa.array([h], pa.int32()), "node": pa.array([node], pa.int32()), "which": pa.array(which), "at": pa.array(at), "gain": pa.array(gain), "value": pa.array(value)})

    summed = blocks.data.mapInArrow(run, "head int, node int, sums binary")
    if meet:
        rows = summed.groupBy("head", "node").applyInArrow(choose, "head int, node int, which long, at long, gain double, value double").collect()  # one row per node
        return {(r["head"], r["node"]): (r["which"], r["at"], r["gain"], r["value"]) for r in rows}
    return level.splits(sum((np.frombuffer(r["sums"], np.int64) for r in summed.collect()), np.zeros(level.cells, np.int64)), s)
