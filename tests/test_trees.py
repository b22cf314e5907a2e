"""Tree ensembles over binned columns against plain recursive versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featsieve.operators import binned, boosting, forest, shadows, trees


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 240
    y = rng.integers(0, 3, n)
    x = np.column_stack([y + rng.normal(0, 0.7, n), rng.normal(size=n), rng.integers(0, 4, n), np.full(n, 2.0), -y + rng.normal(0, 2, n)])
    x[5, 1] = np.nan
    names = ["a", "b", "c", "d", "e f"]
    rows = [(f"k{i}", int(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]], i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, y int, a double, b double, c double, d double, `e f` double, fold int").persist()
    return df, names


def collected(blocks, p):
    parts = [binned.block_rows(r.asDict(), p) for r in blocks.data.collect()]
    codes, y, ids, member, held = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(ids)
    return codes[order], y[order], ids[order], member[order], held[order]


def plain_tree(codes, y, w, cw, spec, path=np.uint64(1), depth=0):
    """Nested (feature, bin, gain, left, right) or class shares."""
    k = len(cw)
    counts = np.bincount(y, weights=w, minlength=k)
    leaf = counts * cw / max((counts * cw).sum(), 1e-300)
    if (counts > 0).sum() < 2 or depth >= spec.depth:
        return leaf

    def purity(sel):
        c = np.bincount(y[sel], weights=w[sel], minlength=k)
        return ((c * cw) ** 2).sum() / max((c * cw).sum(), 1e-300), c.sum()

    for tried in (forest.picked(np.asarray([path], np.uint64), spec.features, spec.pick, spec.salt)[0], spec.features):
        best = (-np.inf, 0, 0)
        for f in tried:
            for b in range(codes[:, f].max() + 1):
                (pl, nl), (pr, nr) = purity(codes[:, f] <= b), purity(codes[:, f] > b)
                if nl and nr:
                    gain = pl + pr - purity(np.ones(len(y), bool))[0]
                    if gain > best[0] + 1e-12:
                        best = (gain, int(f), b)
        if best[0] > -np.inf:
            break
    else:
        return leaf
    gain, f, b = best
    side = codes[:, f] <= b
    kids = forest.child_paths(np.asarray([path], np.uint64))
    return (f, b, gain, plain_tree(codes[side], y[side], w[side], cw, spec, kids[0], depth + 1), plain_tree(codes[~side], y[~side], w[~side], cw, spec, kids[1], depth + 1))


def as_nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.shares[node]
    return (int(tree.feature[node]), int(tree.bin[node]), as_nested(tree, tree.left[node]), as_nested(tree, tree.left[node] + 1))


def same(plain, nested):
    if isinstance(plain, tuple):
        return plain[:2] == nested[:2] and same(plain[3], nested[2]) and same(plain[4], nested[3])
    return np.allclose(plain, nested, atol=1e-6)


def gains_of(plain, p):
    out = np.zeros(p)
    if isinstance(plain, tuple):
        out[plain[0]] += max(plain[2], 0)
        out += gains_of(plain[3], p) + gains_of(plain[4], p)
    return out


@pytest.mark.parametrize("pick,bootstrap,depth", [(0, False, 99), (2, True, 99), (2, True, 3)])
def test_grown_trees_are_those_of_recursion(table, pick, bootstrap, depth):
    df, names = table
    blocks = binned.to_blocks(df, "y", "key", names, 3)
    codes, y, ids, member, _ = collected(blocks, 5)
    cw = np.asarray([1.0, 1.3, 0.8])
    for salt in range(3):
        spec = forest.TreeSpec(0, 0, tuple(range(5)), salt, 0, bootstrap, pick, depth)
        w = forest._weights(spec, ids, member)
        own = w > 0
        want = plain_tree(codes[own], y[own], w[own], cw, spec)
        tree, gains, leaf = forest.grow(codes, y, w, blocks.bins, cw, spec)
        assert same(want, as_nested(tree)) and np.allclose(gains, gains_of(want, 5))
        assert (tree.leaves(codes) == leaf).all()
    blocks.release()


def test_bins_hold_the_order_of_values(table):
    df, names = table
    blocks = binned.to_blocks(df, "y", "key", names, 3)
    codes, _y, ids, *_ = collected(blocks, 5)
    rows = {r.h & (2**64 - 1): r for r in df.select(F.xxhash64(F.col("key")).alias("h"), "b", "c").collect()}
    for f, name in ((1, "b"), (2, "c")):
        pairs = sorted((np.inf if rows[int(i)][name] is None else rows[int(i)][name], int(c)) for i, c in zip(ids, codes[:, f]))
        assert [c for _, c in pairs] == sorted(c for _, c in pairs)
    assert [len(e) + 1 for e in blocks.edges] == [64, 64, 4, 1, 64] and len(binned.edges_of(np.asarray([np.nan]))) == 0
    blocks.release()


def forest_of(df, names, local_rows):
    member = F.lit(1) + F.when(F.col("fold") != 0, 2).otherwise(0)
    blocks = binned.to_blocks(df, "y", "key", names, 3, member, F.when(F.col("fold") == 0, 2).otherwise(0))
    specs = [forest.TreeSpec(t, t % 2, (0, 1, 2, 3, 4) if t < 6 else (0, 2), t, t % 2, True, 2, 12) for t in range(8)]
    weights = {0: np.ones(3), 1: np.asarray([1.0, 1.1, 0.9])}
    grown, tops = forest.grow_forest(blocks, specs, weights, judge=True, keep_trees=True, local_rows=local_rows, vote_rows=20)
    grown = grown.persist()
    found = forest.importances(grown, tops, specs, 5)
    cells = sorted(tuple(r) for r in forest.confusions(grown, 3).collect())
    model = forest.fetch_model(grown, tops, 0, names, blocks.edges)
    predicted = sorted(r[0] for r in model.transform(df).collect())
    grown.unpersist()
    blocks.release()
    return found, cells, predicted, tops


def test_neither_partitions_nor_passes_change_a_forest(table):
    df, names = table
    one = forest_of(df.coalesce(1), names, 50_000)
    many = forest_of(df.repartition(64), names, 20)  # most splits are made by passes
    assert sum(len(t.feature) for t in many[3].values()) > 8 * 9
    for m in (0, 1):
        assert np.allclose(one[0][m], many[0][m], atol=1e-12) and abs(one[0][m].sum() - 1) < 1e-9 and one[0][m][3] == 0
    assert one[1] == many[1] and one[2] == many[2]
    held = df.filter("fold = 0").groupBy("y").count().collect()
    assert {c: sum(n for m, t, _, n in one[1] if t == c) for c in range(3)} == {r["y"]: r["count"] for r in held}
    assert sum(n for m, t, p, n in one[1] if t == p) > 0.5 * 80


@pytest.mark.parametrize("k,nodes,rows,place_rows", [(2, 1, 400, 10**9), (3, 40, 300, 10**9), (3, 40, 300, 0), (9, 7, 500, 0)])
def test_filled_cells_give_the_splits_of_all_cells(monkeypatch, k, nodes, rows, place_rows):
    monkeypatch.setattr(forest, "PLACE_ROWS", place_rows)
    rng = np.random.default_rng(k)
    codes, node = rng.integers(0, 64, (rows, 6)).astype(np.uint8), np.concatenate([np.arange(nodes), rng.integers(0, nodes, rows - nodes)])
    codes[:, 2] = 7  # never varies
    y, weight, cw = rng.integers(0, k, rows), rng.integers(1, 4, rows).astype(float), rng.random(k) + 0.5
    tried = np.stack([np.sort(rng.permutation(6)[:3]) for _ in range(nodes)])
    want = forest.gini_splits(forest.histogram(codes, y, weight, node, tried, 64, k), cw)
    for cells in (forest.HISTOGRAM_CELLS, 3 * 64 * k * 5):  # all nodes at once, five a run
        monkeypatch.setattr(forest, "HISTOGRAM_CELLS", cells)
        f, b, gain, left = forest._level_splits(codes.ravel().astype(int) * k, np.arange(rows) * 6, y, weight, node, tried, 64, cw)
        can = want[2] > -np.inf
        assert (gain == want[2]).all() and (f == tried[np.arange(nodes), want[0]])[can].all() and (b == want[1])[can].all()
        assert all((left[i] == np.bincount(y[own], weight[own], k)).all() for i in np.flatnonzero(can) for own in [(node == i) & (codes[:, f[i]] <= b[i])])


def test_shadow_rounds_share_a_pass(spark, table, monkeypatch):
    df, names = table
    df = df.withColumn("y", F.col("y") % 2)
    monkeypatch.setattr(shadows, "BLOCK_ROWS", 50)
    ranked, n = shadows.ranked_rows(df, "y", "key", names, 3)
    edges = binned.fit_edges(df, "key", names, n)
    packed = shadows.shadow_blocks(ranked, n, edges, range(2), 3).collect()
    columns = [f"{c}{i}" for c in "fs" for i in range(5)]
    for r in range(2):
        blocks = binned.to_blocks(shadows.with_shadows(ranked, n, 5, r, 3), "label", "key", columns, 2, edges=edges * 2)
        codes, y, ids, *_ = collected(blocks, 10)
        own = [b for b in packed if b["model"] == r]
        found = [np.concatenate([np.frombuffer(b[c], t) for b in own]) for c, t in (("codes", np.uint8), ("y", np.int32), ("id", np.uint64))]
        order = np.argsort(found[2])
        assert len(own) == 5 and (found[0].reshape(-1, 10)[order] == codes).all() and (found[1][order] == y).all() and (found[2][order] == ids).all()
        blocks.release()

    def scores(rounds):
        spark.sparkContext.setJobGroup(name := f"shadows {rounds} {forest.WHOLE_ROWS}", name)
        got = sorted(tuple(r) for r in trees.shadow_scores(df, "y", "key", names, rounds, 5, 6).collect())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got, jobs

    (whole, jobs), (_, few) = scores(4), scores(1)
    assert jobs <= few + 1
    monkeypatch.setattr(forest, "WHOLE_ROWS", 0)
    for (i, a), (j, b) in zip(whole, scores(4)[0]):
        assert i == j and a == pytest.approx(b, abs=1e-12)


def test_empty_training_sets_give_leaves(table):
    df, names = table
    blocks = binned.to_blocks(df, "y", "key", names, 3, F.lit(0), F.lit(1))
    grown, tops = forest.grow_forest(blocks, [forest.TreeSpec(0, 0, (0, 1), 1)], {0: np.ones(3)}, judge=True, local_rows=10)
    assert sum(r["n"] for r in forest.confusions(grown, 3).collect()) == 240
    blocks.release()


def test_bootstrap_counts_have_mean_and_variance_one():
    ids = np.arange(200_000, dtype=np.uint64)
    w = binned.bootstrap_counts(ids, 3, 4)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert (binned.draws(ids[:9], 5) != binned.draws(ids[:9], 6)).all()


def plain_boosting(codes, y, ids, k, s, class_weight):
    """Rounds of depth-limited trees by recursion; gains and split counts per feature, scores per row."""
    heads = 1 if k == 2 else k
    scores, gain, splits = np.zeros((len(y), heads)), np.zeros(codes.shape[1]), np.zeros(codes.shape[1])
    for r in range(s.rounds):
        if heads == 1:
            prob = 1 / (1 + np.exp(-scores))
        else:
            e = np.exp(scores - scores.max(1, keepdims=True))
            prob = e / e.sum(1, keepdims=True)
        own = binned.draws(ids, s.seed, 1, r) < s.rows
        new = scores.copy()
        for h in range(heads):
            t = y == (1 if heads == 1 else h)
            w = class_weight[y]
            g, q = w * (prob[:, h] - t), w * (1 if heads == 1 else 2) * prob[:, h] * (1 - prob[:, h])
            columns = boosting.tried_columns(codes.shape[1], s.columns, s.seed, r, h)

            def node(fit, every, depth):
                G, H = g[fit].sum(), q[fit].sum()
                best = (1e-9, None)
                for f in columns if depth < s.depth else ():
                    for b in range(63):
                        a, z = fit & (codes[:, f] <= b), fit & (codes[:, f] > b)
                        if min(a.sum(), z.sum()) >= s.min_rows and min(q[a].sum(), q[z].sum()) >= s.min_hessian:
                            x = sum(g[i].sum() ** 2 / (q[i].sum() + s.l2) for i in (a, z)) - G * G / (H + s.l2)
                            if x > best[0] + 1e-7:
                                best = (x, (f, b))
                if best[1] is None:
                    new[every, h] += -G / (H + s.l2) * s.rate
                    return
                f, b = best[1]
                gain[f] += best[0]
                splits[f] += 1
                node(fit & (codes[:, f] <= b), every & (codes[:, f] <= b), depth + 1)
                node(fit & (codes[:, f] > b), every & (codes[:, f] > b), depth + 1)

            node(own, np.ones(len(y), bool), 0)
        scores = new
    return gain, splits, scores


@pytest.mark.parametrize("classes,balanced,way", [(3, False, "local"), (2, True, "meet"), (3, True, "collect")])
def test_boosting_against_recursion(table, monkeypatch, classes, balanced, way):
    df, names = table
    monkeypatch.setattr(boosting, "COLLECTED_BYTES", 0 if way == "meet" else 100_000_000)
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 1_000 if way == "local" else 0)
    df = df.withColumn("y", F.least("y", F.lit(classes - 1)))
    s = boosting.Settings(rounds=4, depth=3, rate=0.3, min_rows=5, min_hessian=0.5, balanced=balanced)
    cw = np.asarray([1.5, 0.8, 1.0])[:classes]
    found = []
    for parts in (1, 12):
        blocks = binned.to_blocks(df.repartition(parts), "y", "key", names, classes)
        found.append(boosting.boost(blocks, s, cw))
        codes, y, ids, *_ = collected(blocks, 5)
        blocks.release()
    gain, splits, scores = plain_boosting(codes, y, ids, classes, s, cw if balanced else np.ones(classes))
    for model in found:
        assert (model.splits == splits).all() and splits.sum() > 10 and np.allclose(model.gain, gain, rtol=1e-4)
        assert np.allclose(model.add(np.zeros((len(y), model.heads)), codes, 0), scores, atol=1e-5)
    assert all((a.feature == b.feature).all() and (a.bin == b.bin).all() and (a.value == b.value).all() for x, z in zip(found[0].trees, found[1].trees) for a, b in zip(x, z))


@pytest.mark.parametrize("classes,settings", [(2, {"rows": 1.0, "columns": 1.0, "l2": 0.0, "min_hessian": 1e-3, "min_rows": 20, "balanced": True}), (3, {"rows": 0.7, "rate": 0.3})])
def test_a_task_boosts_many_rows_as_passes_do(spark, monkeypatch, classes, settings):
    df = spark.range(60_000).select(F.col("id").alias("key"), *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(m)) + F.lit(0.0)).alias(c) for c, m in (("a", 200), ("b", 7), ("c", 50))])
    df = df.withColumn("y", F.when(F.col("a") * F.col("b") > 600, 0).when(F.col("c") > F.col("a"), classes - 1).otherwise(1))
    blocks = binned.to_blocks(df, "y", "key", ["a", "b", "c"], classes)
    s, found = boosting.Settings(rounds=3, depth=4, **settings), []
    for name in ("task", "passes"):
        spark.sparkContext.setJobGroup(f"boost {classes} {name}", name)
        model = boosting.boost(blocks, s, np.asarray([3.0, 0.7, 1.0])[:classes])
        found.append((model, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boost {classes} {name}"))))
        monkeypatch.setattr(boosting, "LOCAL_ROWS", 0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    blocks.release()
    (one, jobs), (many, passes) = found
    assert jobs < 4 and passes >= 3 * 5
    assert (one.splits == many.splits).all() and (one.gain == many.gain).all() and one.splits.sum() > 9
    assert all((x.feature == z.feature).all() and (x.bin == z.bin).all() and (x.value == z.value).all() for a, b in zip(one.trees, many.trees) for x, z in zip(a, b))


def test_scores_are_made_anew_where_a_worker_has_none():
    model = boosting.Boosted(2, 1, 1)
    codes = np.asarray([[0], [3]], np.uint8)
    tree = boosting.BoostTree.empty(1)
    tree.feature[0], tree.bin[0], tree.value[1:] = 0, 1, [0.5, -0.5]
    model.trees.append([tree])
    assert boosting.kept_scores(model, b"x", codes).ravel().tolist() == [0.5, -0.5]
    model.trees.append([tree])
    assert boosting.kept_scores(model, b"x", codes).ravel().tolist() == [1.0, -1.0] == boosting.kept_scores(model, b"y", codes).ravel().tolist()
    other = boosting.Boosted(2, 1, 1)
    assert boosting.kept_scores(other, b"x", codes).ravel().tolist() == [0.0, 0.0]
