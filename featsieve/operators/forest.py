"""Random forests and single trees, many at a time: the trees of all folds and feature sets are grown in the same passes.

A node with more than ``LOCAL_ROWS`` rows is split by a pass over the blocks: tasks sum class counts by (tree, node,
feature, bin), the sums meet by node, and only the chosen splits leave the executors. Rows of smaller nodes meet by
(tree, node), and the task that has them grows the rest of the tree. Where all rows fit a task, ``whole_importances`` sends
blocks of rows to tasks that grow many whole trees each. Counts are whole numbers and all draws are functions
of (seed, tree, row key or node), so the trees do not depend on the partitioning nor on where growing goes local.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .binned import Blocks, _mix, block_rows, bootstrap_counts, code_columns, number_columns, salted

LOCAL_ROWS = 50_000
WHOLE_ROWS = 2_000_000  # rows that tasks grow whole trees on, about 250 MB in a worker with 10 columns
TASKS_PER_CORE = 12
HISTOGRAM_CELLS = 4_000_000  # counts a task holds at once
PLACE_ROWS = 100_000  # rows times tried features from which a level counts one feature after the other
VOTES = 1 << 30  # a tree's class shares are whole numbers of this size, so sums do not depend on their order
MODEL_BYTES = 512_000_000


@dataclass(frozen=True)
class TreeSpec:
    """What a tree is grown on: the rows whose ``member`` bit ``bit`` is set, judged on those with the ``held`` bit."""

    tree: int
    model: int
    features: tuple[int, ...]
    salt: int
    bit: int = 0
    bootstrap: bool = True
    pick: int = 0  # features tried per node; 0: all
    depth: int = 1 << 20


@dataclass
class Tree:
    """Nodes by number, the root first; feature -1 is a leaf. ``shares`` are the class shares of each node."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    shares: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """Node number of every row."""
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            here = at[rows]
            at[rows] = self.left[here] + (codes[rows, self.feature[here]] > self.bin[here])
        return at


def child_paths(paths: np.ndarray) -> np.ndarray:
    """Names of the left and right children, in this order."""
    with np.errstate(over="ignore"):
        return _mix(np.repeat(paths, 2) * np.uint64(2) + np.tile(np.asarray([1, 2], np.uint64), len(paths)))


def picked(paths: np.ndarray, features: Sequence[int], pick: int, salt: int) -> np.ndarray:
    """Features to try at each node, in column order."""
    own = np.asarray(features)
    if not pick or pick >= len(own):
        return np.tile(own, (len(paths), 1))
    with np.errstate(over="ignore"):
        keys = salted(paths[:, None] + np.arange(1, len(own) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), salt)
    return own[np.sort(np.argpartition(keys, pick, axis=1)[:, :pick], axis=1)]


def histogram(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, node: np.ndarray, tried: np.ndarray, bins: int, classes: int) -> np.ndarray:
    """Weighted class counts [node, tried feature, bin, class]."""
    nodes, m = tried.shape
    own = codes[np.arange(len(codes))[:, None], tried[node]].astype(np.int64)
    at = ((node[:, None] * m + np.arange(m)) * bins + own) * classes + y[:, None]
    return np.bincount(at.ravel(), weights=np.repeat(weight, m), minlength=nodes * m * bins * classes).reshape(nodes, m, bins, classes)


def gini_splits(counts: np.ndarray, class_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tried feature, bin, gain) of the best split of each node; the gain is -inf where no split has rows on both sides."""
    left = np.cumsum(counts, axis=2)[:, :, :-1]
    whole = counts[:, :1].sum(axis=2, keepdims=True)
    if not left.shape[2]:
        return np.zeros(len(counts), int), np.zeros(len(counts), int), np.full(len(counts), -np.inf)
    right = whole - left

    def purity(c: np.ndarray) -> np.ndarray:
        w = c * class_weight
        return (w * w).sum(-1) / np.maximum(w.sum(-1), 1e-300)

    gain = purity(left) + purity(right) - purity(whole)
    gain[(left.sum(-1) == 0) | (right.sum(-1) == 0)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return best // gain.shape[2], best % gain.shape[2], flat[np.arange(len(flat)), best]


def _run_splits(flat: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, node: np.ndarray, tried: np.ndarray, bins: int, class_weight: np.ndarray):
    """Best splits of the nodes of a run: what ``gini_splits`` finds, from the cells that hold rows alone, and their counts on the left.

    An empty cell's split is that of the filled cell before it, so none is missed and ties go to the same bin. ``flat`` holds
    codes times the classes; rows whose node is the number of nodes are not counted.
    """
    (nodes, m), k = tried.shape, len(class_weight)
    base, size, places = node * (bins * k) + y, nodes * bins * k, np.vstack([tried, tried[:1]]).T.copy()
    if m * len(node) < PLACE_ROWS:
        at = base + flat[first + places[:, node]] + np.arange(m)[:, None] * (size + bins * k)
        counts = np.bincount(at.ravel(), weights=np.tile(weight, m), minlength=m * (size + bins * k)).reshape(m, -1)[:, :size].reshape(-1, k)
    else:
        counts = np.concatenate([np.bincount(base + flat[first + f[node]], weights=weight, minlength=size)[:size] for f in places]).reshape(-1, k)
    filled = np.flatnonzero(_row_sums(counts))
    starts = filled.searchsorted(np.arange(m * nodes) * bins)  # [place, node]; a node has rows, so each of its places has cells
    ends = np.append(starts[1:], len(filled)) - 1
    sizes = ends - starts + 1
    left = counts[filled].cumsum(axis=0)
    before = left[ends]
    whole = before[:nodes].copy()
    whole[1:] -= before[: nodes - 1]
    left[sizes[0] :] -= before[:-1].repeat(sizes[1:], axis=0)
    of = np.tile(np.arange(nodes), m).repeat(sizes)

    def purity(c: np.ndarray) -> np.ndarray:
        w = c * class_weight
        return _row_sums(w * w) / np.maximum(_row_sums(w), 1e-300)

    gain = purity(left) + purity(whole[of] - left) - purity(whole)[of]
    gain[ends] = -np.inf  # nothing is right of a place's last cell
    each = np.maximum.reduceat(gain, starts).reshape(m, nodes)
    which = each.argmax(axis=0)
    best = each[which, np.arange(nodes)]
    segment = which * nodes + np.arange(nodes)
    hits = np.flatnonzero(gain == best[of])
    cell = hits[hits.searchsorted(starts[segment])]  # a place's first cell with its best gain
    return which, filled[cell] % bins, best, left[cell]


def _row_sums(x: np.ndarray) -> np.ndarray:
    """``x.sum(axis=1)``, which is slow for a few columns; fewer than eight are summed in order there, too."""
    if x.shape[1] > 7:
        return x.sum(axis=1)
    out = x[:, 0].copy()
    for c in range(1, x.shape[1]):
        out += x[:, c]
    return out


def _level_splits(flat, first, y, weight, node, tried, bins, class_weight):
    """(feature, bin, gain, counts on the left) of the best splits of a level, in runs of nodes whose counts fit.

    Rows begin at ``first`` in ``flat``; those whose node is the number of nodes take no part.
    """
    nodes, m = tried.shape
    width = max(1, HISTOGRAM_CELLS // max(1, m * bins * len(class_weight)))
    if nodes <= width:
        which, *rest = _run_splits(flat, first, y, weight, node, tried, bins, class_weight)
        return tried[np.arange(nodes), which], *rest
    order = np.argsort(node, kind="stable")
    edges = np.searchsorted(node[order], np.minimum(np.arange(0, nodes + width, width), nodes))
    parts = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        rows, begin = order[a:b], i * width
        parts.append(_run_splits(flat, first[rows], y[rows], weight[rows], node[rows] - begin, tried[begin : begin + width], bins, class_weight))
    which, *rest = (np.concatenate(x) for x in zip(*parts))
    return tried[np.arange(nodes), which], *rest


def grow(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, bins: int, class_weight: np.ndarray, spec: TreeSpec, path: int = 1, depth: int | None = None) -> tuple[Tree, np.ndarray, np.ndarray]:
    """(tree, summed gain per feature, leaf of every row), level by level; rows of weight 0 only find their leaf."""
    k, depth = len(class_weight), spec.depth if depth is None else depth
    feature, bin_, left, shares = [], [], [], []
    gains, at = np.zeros(codes.shape[1]), np.zeros(len(codes), np.int64)
    p, flat = codes.shape[1], codes.ravel().astype(np.uint16 if bins * k < 1 << 16 else np.int64) * k
    first, node = np.arange(len(codes)) * p, np.zeros(len(codes), np.int64)
    yr, wr = y.astype(np.int64), weight.astype(float)
    paths, counts, made = np.asarray([path], np.uint64), np.bincount(y, weights=weight, minlength=k)[None], 1
    begin = 0  # number of the level's first node

    def close(still: np.ndarray, names: np.ndarray) -> None:
        """Rows whose node is not in ``still`` stay where they are; they are taken out once they are many."""
        nonlocal first, node, yr, wr
        place = np.full(len(names) + 1, len(still))
        place[still] = np.arange(len(still))
        done = np.ones(len(names) + 1, bool)
        done[still] = done[-1] = False  # the last are those closed before
        if done.any():
            out = np.flatnonzero(done[node])
            at[first[out] // p] = names[node[out]]
        node = place[node]
        gone = np.count_nonzero(node == len(still))
        if 8 * gone > len(node):
            inside = np.flatnonzero(node < len(still))
            first, node, yr, wr = first[inside], node[inside], yr[inside], wr[inside]

    for level in range(depth + 1):
        n = len(counts)
        w = counts * class_weight
        shares.append(w / np.maximum(w.sum(1, keepdims=True), 1e-300))
        f, b, l = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        open_ = np.flatnonzero(((counts > 0).sum(1) > 1) & (level < depth))
        names = begin + np.arange(n)
        begin = made
        if len(open_) < n:
            close(open_, names)
        if len(open_):
            fs, bs, gs, lefts = _level_splits(flat, first, yr, wr, node, picked(paths[open_], spec.features, spec.pick, spec.salt), bins, class_weight)
            none = np.flatnonzero(np.isneginf(gs))
            if len(none) and spec.pick and spec.pick < len(spec.features):  # no tried feature varies here: try all
                again = np.full(len(open_) + 1, -1)
                again[none] = np.arange(len(none))
                r = np.flatnonzero(again[node] >= 0)
                fs[none], bs[none], gs[none], lefts[none] = _level_splits(flat, first[r], yr[r], wr[r], again[node[r]], np.tile(np.asarray(spec.features), (len(none), 1)), bins, class_weight)
            split = np.flatnonzero(~np.isneginf(gs))
            np.add.at(gains, fs[split], np.maximum(gs[split], 0.0))
            f[open_[split]], b[open_[split]], l[open_[split]] = fs[split], bs[split], made + 2 * np.arange(len(split))
            if len(split) < len(open_):
                close(split, names[open_])
            cut_at = np.append(bs[split] * k, 0).astype(flat.dtype)
            side = flat[first + np.append(fs[split], 0)[node]] > cut_at[node]
            node = 2 * node + (side & (node < len(split)))
            counts = np.stack([lefts[split], counts[open_[split]] - lefts[split]], axis=1).reshape(-1, k)
            paths = child_paths(paths[open_[split]])
        else:
            split = open_
        feature.append(f), bin_.append(b), left.append(l)
        made += 2 * len(split)
        if not len(split):
            break
    return Tree(np.concatenate(feature), np.concatenate(bin_), np.concatenate(left), np.concatenate(shares).astype(np.float32)), gains, at


@dataclass
class Top:
    """The splits of a tree made by passes; ``open`` are nodes still to be grown: node -> (path, depth)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    place: list[tuple[int, int]] = field(default_factory=lambda: [(1, 0)])  # path, depth
    gains: dict[int, float] = field(default_factory=dict)
    small: set[int] = field(default_factory=lambda: {0})  # nodes to be grown by one task

    def route(self, codes: np.ndarray) -> np.ndarray:
        return Tree(np.asarray(self.feature), np.asarray(self.bin), np.asarray(self.left), np.zeros(0)).leaves(codes)


def _weights(spec: TreeSpec, ids: np.ndarray, member: np.ndarray) -> np.ndarray:
    inside = (member >> spec.bit) & 1
    return inside * bootstrap_counts(ids, spec.salt, 1) if spec.bootstrap else inside


def _tops(blocks: Blocks, specs: Sequence[TreeSpec], class_weights: dict[int, np.ndarray], local_rows: int) -> dict[int, Top]:
    """Split all nodes with more than ``local_rows`` rows."""
    tops = {s.tree: Top() for s in specs}
    if blocks.rows <= local_rows:
        return tops
    p, bins, k = len(blocks.edges), blocks.bins, blocks.classes
    by_tree = {s.tree: s for s in specs}
    todo = {(s.tree, 0): False for s in specs}  # large nodes; whether all features are tried
    for top in tops.values():
        top.small.clear()
    while todo:
        # as many trees a pass as one task can count for
        batch, cells = {}, 0
        for (tree, node), every in sorted(todo.items()):
            spec = by_tree[tree]
            m = len(spec.features) if every or not spec.pick else min(spec.pick, len(spec.features))
            if batch and cells + m * bins * k > 4 * HISTOGRAM_CELLS:
                break
            cells += m * bins * k
            paths = np.asarray([tops[tree].place[node][0]], np.uint64)
            batch.setdefault(tree, {})[node] = picked(paths, spec.features, 0 if every else spec.pick, spec.salt)[0]
        known = {t: tops[t] for t in batch}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for row in b.to_pylist():
                    codes, y, ids, member, _held = block_rows(row, p)
                    for tree, nodes in batch.items():
                        weight = _weights(by_tree[tree], ids, member)
                        at = known[tree].route(codes)
                        for node, tried in nodes.items():
                            own = np.flatnonzero((at == node) & (weight > 0))
                            found = histogram(codes[own], y[own], weight[own], np.zeros(len(own), np.int64), tried[None], bins, k)[0].astype(np.int64)
                            sums[tree, node] = sums[tree, node] + found if (tree, node) in sums else found
            for (tree, node), found in sums.items():
                yield pa.RecordBatch.from_pydict({"tree": [tree], "node": [node], "counts": [found.tobytes()]})

        def choose(part: pa.Table) -> pa.Table:
            tree, node = part["tree"][0].as_py(), part["node"][0].as_py()
            tried = batch[tree][node]
            total = sum(np.frombuffer(c.as_py(), np.int64) for c in part["counts"]).reshape(1, len(tried), bins, k).astype(float)
            which, at, gain = gini_splits(total, class_weights[by_tree[tree].bit])
            cut = np.cumsum(total[0, which[0]], axis=0)[at[0]]
            whole = total[0, 0].sum(axis=0)
            sides = [cut.sum(), (whole - cut).sum()]
            pure = [int((cut > 0).sum() < 2), int((whole - cut > 0).sum() < 2)]
            return pa.table({"tree": [tree], "node": [node], "feature": [int(tried[which[0]])], "bin": [int(at[0])], "gain": [float(gain[0])], "left_rows": [int(sides[0])], "right_rows": [int(sides[1])],
                             "pure": [int((whole > 0).sum() < 2)], "left_pure": [pure[0]], "right_pure": [pure[1]]})

        counted = blocks.data.mapInArrow(count, "tree long, node long, counts binary")
        found = counted.groupBy("tree", "node").applyInArrow(choose, "tree long, node long, feature long, bin long, gain double, left_rows long, right_rows long, pure long, left_pure long, right_pure long")
        met = set()
        for r in sorted(found.collect(), key=lambda r: (r["tree"], r["node"])):  # one row per large node
            met.add((r["tree"], r["node"]))
            tree, node, spec = r["tree"], r["node"], by_tree[r["tree"]]
            every, top = todo.pop((tree, node)), tops[tree]
            path, depth = top.place[node]
            if r["pure"] or depth >= spec.depth or np.isneginf(r["gain"]):
                if not r["pure"] and depth < spec.depth and not every and spec.pick and spec.pick < len(spec.features):
                    todo[tree, node] = True
                else:
                    top.small.add(node)  # a leaf; the task that gets its rows sees that
                continue
            first = len(top.feature)
            top.feature[node], top.bin[node], top.left[node] = r["feature"], r["bin"], first
            top.gains[r["feature"]] = top.gains.get(r["feature"], 0.0) + max(0.0, r["gain"])
            for i, (name, n) in enumerate(zip(child_paths(np.asarray([path], np.uint64)).tolist(), (r["left_rows"], r["right_rows"]))):
                top.feature.append(-1), top.bin.append(0), top.left.append(0), top.place.append((name, depth + 1))
                leaf = depth + 1 >= spec.depth or r[("left_pure", "right_pure")[i]]
                if n > local_rows and not leaf:
                    todo[tree, first + i] = False
                else:
                    top.small.add(first + i)
        for tree, nodes in batch.items():
            for node in nodes.keys() - {n for t, n in met if t == tree}:  # none of its rows is drawn
                todo.pop((tree, node))
                tops[tree].small.add(node)
    return tops


GROWN = "tree long, model long, node long, gains binary, grown binary, bucket long, votes binary"


def grow_forest(blocks: Blocks, specs: Sequence[TreeSpec], class_weights: dict[int, np.ndarray], judge: bool = False, keep_trees: bool = False, local_rows: int | None = None, vote_rows: int = 2_000) -> tuple[DataFrame, dict[int, Top]]:
    """Rows of two kinds: a grown (sub)tree with its gains, or, with ``judge``, the votes of a tree for held rows.

    ``class_weights``: per member bit. A row of votes holds (id, y, class shares) of the held rows of one hash bucket.
    The second result are the splits made by passes.
    """
    p, bins, k = len(blocks.edges), blocks.bins, blocks.classes
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    tops = _tops(blocks, specs, class_weights, local_rows)
    buckets = max(1, -(-blocks.rows // vote_rows))
    spread = blocks.data.sparkSession.sparkContext.broadcast((list(specs), tops))
    by_tree = {s.tree: s for s in specs}
    sent = pa.schema([("tree", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("y", pa.binary()), ("weight", pa.binary()), ("id", pa.binary()), ("held", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = spread.value
        for b in batches:
            for row in b.to_pylist():
                codes, y, ids, member, held = block_rows(row, p)
                for spec in wanted:
                    weight = _weights(spec, ids, member)
                    judged = ((held >> spec.bit) & 1 == 1) if judge else np.zeros(len(ids), bool)
                    own = np.flatnonzero((weight > 0) | judged)
                    top = known[spec.tree]
                    at = top.route(codes[own]) if len(top.feature) > 1 else np.zeros(len(own), np.int64)
                    for node in np.unique(at).tolist():
                        r = own[at == node]
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((
                            spec.tree, node, len(r), codes[r].tobytes(), y[r].tobytes(), weight[r].astype(np.int32).tobytes(), ids[r].tobytes(), judged[r].tobytes()), sent)], schema=sent)

    out_schema = pa.schema([("tree", pa.int64()), ("model", pa.int64()), ("node", pa.int64()), ("gains", pa.binary()), ("grown", pa.binary()), ("bucket", pa.int64()), ("votes", pa.binary())])

    def grown(key: tuple, part: pa.Table) -> pa.Table:
        tree, node = key[0].as_py(), key[1].as_py()
        spec = by_tree[tree]
        rows = part.to_pylist()
        codes = np.concatenate([np.frombuffer(r["codes"], np.uint8).reshape(r["n"], p) for r in rows])
        y, weight, ids, judged = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("y", np.int32), ("weight", np.int32), ("id", np.uint64), ("held", bool)))
        path, depth = spread.value[1][tree].place[node]
        own, gains, leaf = grow(codes, y, weight, bins, class_weights[spec.bit], spec, path, max(0, spec.depth - depth))
        out = [(tree, spec.model, node, gains.tobytes(), pickle.dumps((own.feature, own.bin, own.left, own.shares)) if keep_trees else None, None, None)]
        if judged.any():
            shares = np.rint(own.shares[leaf[judged]].astype(float) * VOTES).astype(np.int64)
            table = np.column_stack([ids[judged].view(np.int64), y[judged], shares])
            home = ids[judged] % np.uint64(buckets)
            out += [(tree, spec.model, None, None, None, int(h), table[home == h].tobytes()) for h in np.unique(home)]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*out), out_schema)], schema=out_schema)

    dealt = blocks.data.mapInArrow(deal, "tree long, node long, n long, codes binary, y binary, weight binary, id binary, held binary")
    return dealt.groupBy("tree", "node").applyInArrow(grown, GROWN), tops


def importances(grown: DataFrame, tops: dict[int, Top], specs: Sequence[TreeSpec], p: int) -> dict[int, np.ndarray]:
    """Per model the mean over trees of the gains, each tree's scaled to sum 1."""
    per_tree = {s.tree: np.zeros(p) for s in specs}
    # a row per tree and node grown by a task
    for r in sorted(grown.filter("gains is not null").select("tree", "node", "gains").collect(), key=lambda r: (r["tree"], r["node"])):
        per_tree[r["tree"]] += np.frombuffer(r["gains"])
    out: dict[int, list[np.ndarray]] = {}
    for s in specs:
        gains = per_tree[s.tree]
        for f, g in tops[s.tree].gains.items():
            gains[f] += g
        out.setdefault(s.model, []).append(gains / gains.sum() if gains.sum() > 0 else gains)
    return {m: np.mean(each, axis=0) for m, each in out.items()}


def _slots(spark: SparkSession, n: int) -> list[int]:
    """Numbers that ``repartition(n, number)`` puts into a partition each, so that no two groups of much work share one."""
    place = F.pmod(F.hash("slot"), F.lit(n))
    tried = spark.range(64 * n).select(F.col("id").cast("int").alias("slot")).groupBy(place.alias("place")).agg(F.min("slot").alias("slot")).collect()
    first = {r["place"]: r["slot"] for r in tried}
    return [first.get(i, 64 * n + i) for i in range(n)]


def whole_importances(data: DataFrame, specs: Sequence[TreeSpec], class_weight: np.ndarray, p: int, bins: int) -> dict[int, np.ndarray]:
    """Per model the mean over trees of the gains, each tree's scaled to sum 1, as ``importances`` has it.

    ``data``: blocks (model, n, codes, y, id) of ``WHOLE_ROWS`` rows a model at most. A model's blocks go to each of the tasks
    that share its trees, so what moves is a few copies of the blocks and not the drawn rows of every tree.
    """
    by_model: dict[int, list[TreeSpec]] = {}
    for s in specs:
        by_model.setdefault(s.model, []).append(s)
    wanted = TASKS_PER_CORE * data.sparkSession.sparkContext.defaultParallelism
    lots = max(1, min(-(-wanted // len(by_model)), max(map(len, by_model.values()))))

    slots = _slots(data.sparkSession, lots * len(by_model))
    shares = dict(zip(slots, ((m, lot) for m in by_model for lot in range(lots))))
    slots_of = F.create_map(*[F.lit(x) for i, m in enumerate(by_model) for x in (m, slots[i * lots : (i + 1) * lots])])

    def grown(key: tuple, part: pa.Table) -> pa.Table:
        model, lot = shares[key[0].as_py()]
        codes = np.concatenate([np.frombuffer(c.as_py(), np.uint8) for c in part["codes"]]).reshape(-1, p)
        y, ids = (np.concatenate([np.frombuffer(v.as_py(), t) for v in part[c]]) for c, t in (("y", np.int32), ("id", np.uint64)))
        del part
        out = []
        for s in by_model[model][lot::lots]:
            weight = _weights(s, ids, np.ones(len(ids), np.int64))
            own = np.flatnonzero(weight > 0)
            _tree, gains, _leaf = grow(codes[own], y[own], weight[own], bins, class_weight, s)
            out.append((s.tree, gains.tobytes()))
        return pa.table({"tree": pa.array([t for t, _ in out], pa.int64()), "gains": pa.array([g for _, g in out], pa.binary())})

    dealt = data.withColumn("slot", F.explode(slots_of[F.col("model")])).repartition(len(slots), "slot").groupBy("slot")
    found = {r["tree"]: np.frombuffer(r["gains"]) for r in dealt.applyInArrow(grown, "tree long, gains binary").collect()}  # a row per tree
    each = {m: [found.get(s.tree, np.zeros(p)) for s in own] for m, own in by_model.items()}
    return {m: np.mean([g / g.sum() if g.sum() > 0 else g for g in own], axis=0) for m, own in each.items()}


def confusions(grown: DataFrame, classes: int) -> DataFrame:
    """model, y_true, y_pred, n: each held row's class with the most votes (ties: the lower class)."""
    width = classes + 2

    def judge(key: tuple, part: pa.Table) -> pa.Table:
        votes = np.concatenate([np.frombuffer(v.as_py(), np.int64).reshape(-1, width) for v in part["votes"]])
        ids, first, which = np.unique(votes[:, 0], return_index=True, return_inverse=True)
        total = np.zeros((len(ids), classes), np.int64)
        np.add.at(total, which, votes[:, 2:])
        pairs, n = np.unique(np.column_stack([votes[first, 1], total.argmax(axis=1)]), axis=0, return_counts=True)
        return pa.table({"model": pa.array([key[0].as_py()] * len(n), pa.int64()), "y_true": pa.array(pairs[:, 0], pa.int32()), "y_pred": pa.array(pairs[:, 1], pa.int32()), "n": pa.array(n, pa.int64())})

    judged = grown.filter("votes is not null").select("model", "bucket", "votes").groupBy("model", "bucket").applyInArrow(judge, "model long, y_true int, y_pred int, n long")
    return judged.groupBy("model", "y_true", "y_pred").agg(F.sum("n").alias("n"))


@dataclass
class ForestModel:
    """Grown trees with the edges of their columns; ``transform`` adds ``prediction`` to a table with the columns."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[tuple[Top, dict[int, Tree]]]

    def predict(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        codes, votes = code_columns(columns, self.edges), 0
        for top, parts in self.trees:
            at = top.route(codes)
            shares = np.zeros((len(codes), next(iter(parts.values())).shares.shape[1]))
            for node, tree in parts.items():
                own = np.flatnonzero(at == node)
                shares[own] = tree.shares[tree.leaves(codes[own])]
            votes = votes + np.rint(shares * VOTES).astype(np.int64)
        return votes.argmax(axis=1)

    def transform(self, df: DataFrame) -> DataFrame:
        shipped = df.sparkSession.sparkContext.broadcast(self)  # its size was checked when it was fetched
        p = len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = shipped.value.predict([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)])
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(float))], names=["prediction"])

        return df.select(*number_columns(self.features)).mapInArrow(run, "prediction double")


def fetch_model(grown: DataFrame, tops: dict[int, Top], model: int, features: Sequence[str], edges: list[np.ndarray]) -> ForestModel:
    """The trees of one model, ``MODEL_BYTES`` at most."""
    rows = grown.filter((F.col("model") == model) & F.col("grown").isNotNull())
    size = rows.agg(F.sum(F.octet_length("grown"))).head()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"the model has {size} bytes; up to {MODEL_BYTES} are sent to the tasks")
    parts: dict[int, dict[int, Tree]] = {}
    for r in rows.select("tree", "node", "grown").collect():
        parts.setdefault(r["tree"], {})[r["node"]] = Tree(*pickle.loads(r["grown"]))
    return ForestModel(list(features), edges, [(tops[t], parts[t]) for t in sorted(parts)])
