import numpy as np
import pytest
from pyspark.sql import functions as F

from featsieve.operators import filters, mrmr, mutual_info, relief, suite
from featsieve.operators import batch_logistic
from featsieve.operators.batch_logistic import BatchLogistic, Problem, packed, weighted_f1
from featsieve.operators.linear import logistic_input


@pytest.fixture(scope="module")
def table(spark):
    """Two informative columns, noise, a constant; three classes, 180 rows."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 180)
    x = np.column_stack([y + rng.normal(0, 0.5, 180), rng.normal(size=180), -2.0 * y + rng.normal(0, 1.5, 180), np.full(180, 4.0)])
    rows = [(f"{i:03d}", int(y[i]), *map(float, x[i])) for i in range(180)]
    df = spark.createDataFrame(rows, "key string, y int, a double, b double, c double, d double").persist()
    return df, x, y, ["a", "b", "c", "d"]


def by_pos(scores):
    return np.array([r["score"] for r in scores.orderBy("pos").collect()])


@pytest.mark.parametrize("wide", [16, 2])
def test_one_pass_filters(table, monkeypatch, wide):
    df, x, y, names = table
    monkeypatch.setattr(filters, "WIDE_LIMIT", wide)
    stats = filters.class_stats(df, "y", names)
    pearson = [0.0 if np.std(c) == 0 else abs(np.corrcoef(c, y)[0, 1]) for c in x.T]
    assert np.allclose(by_pos(filters.pearson_scores(stats)), pearson)
    num = sum((y == k).sum() * (x[y == k].mean(0) - x.mean(0)) ** 2 for k in range(3))
    den = sum((y == k).sum() * x[y == k].var(0) for k in range(3))
    assert np.allclose(by_pos(filters.fisher_scores(stats)), num / (den + 1e-12))
    span = np.ptp(x, axis=0)
    z = (x - x.min(0)) / np.where(span == 0, 1, span)
    seen = np.array([z[y == k].sum(0) for k in range(3)])
    want = np.array([[(y == k).mean()] for k in range(3)]) * z.sum(0)
    with np.errstate(invalid="ignore"):
        assert np.allclose(by_pos(filters.chi2_scores(stats)), np.nan_to_num((seen - want) ** 2 / want).sum(0))


def psi(n):
    return np.sum(1.0 / np.arange(1, n)) - 0.5772156649015329


def brute_mi(x, y, k=3):
    n, total = len(x), 0.0
    for i in range(n):
        same = np.abs(x[y == y[i]] - x[i])
        kk = min(k, len(same) - 1)
        d = np.sort(same)[kk]
        total += psi(kk) - psi(len(same)) - psi(max(1, (np.abs(x - x[i]) < d).sum()))
    return max(0.0, psi(n) + total / n)


@pytest.mark.parametrize("rows_per_sort", [1_000_000, 25])
def test_knn_mutual_information(table, rows_per_sort):
    df, x, y, names = table
    got = by_pos(mutual_info.knn_scores(df, "y", "key", names[:3], rows_per_sort=rows_per_sort))
    assert np.allclose(got, [brute_mi(x[:, j], y) for j in range(3)], atol=1e-6)


def test_knn_mutual_information_drops_single_row_labels(spark):
    rows = [(str(i), i // 2 if i < 8 else 9, float(i * i % 13)) for i in range(9)]
    df = spark.createDataFrame(rows, "key string, y int, a double")
    x, y = np.array([r[2] for r in rows[:8]]), np.array([r[1] for r in rows[:8]])
    x = x + np.arange(8) * 1e-9  # distinct values
    df = spark.createDataFrame([(r[0], r[1], float(v)) for r, v in zip(rows, [*x, 5.5])], "key string, y int, a double")
    assert by_pos(mutual_info.knn_scores(df, "y", "key", ["a"]))[0] == pytest.approx(brute_mi(x, y), abs=1e-6)


def test_relief_against_loops(table):
    df, x, y, names = table
    want = np.zeros(4)
    for i in range(180):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:10]
        for sign, group in ((-1, near[y[near] == y[i]]), (1, near[y[near] != y[i]])):
            if len(group):
                want += sign * np.abs(x[i] - x[group]).mean(0) / 180
    assert np.allclose(by_pos(relief.relief_scores(df, "y", "key", names)), want)
    # all rows, by pieces of cells of every size
    assert np.allclose(by_pos(relief.relief_scores(df, "y", "key", names, max_rows=None)), want)
    assert np.allclose(by_pos(relief._whole_scores(df, "y", "key", names, 10, 3, piece_rows=7, pivots=12)), want)
    assert not by_pos(relief.relief_scores(df.limit(2), "y", "key", names, max_rows=None)).any()
    assert not by_pos(relief.relief_scores(df.limit(2), "y", "key", names)).any()


def test_neighbours_with_ties_copies_and_a_hot_pivot(spark):
    from featsieve.operators import neighbors

    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros((60, 2)), rng.integers(0, 4, (60, 2)), rng.normal(20, 5, (40, 2))])  # a third are one point
    keys = [f"k{i:03d}" for i in rng.permutation(160)]
    df = spark.createDataFrame([(k, i % 3, *map(float, v)) for i, (k, v) in enumerate(zip(keys, x))], "key string, y int, a double, b double")
    found = []
    for parts, piece_rows, pivots in ((1, 2_000, 1), (9, 10, 8)):
        near, _rows, n = neighbors.nearest_rows(df.repartition(parts), "key", "y", ["a", "b"], 5, 1, piece_rows, pivots)
        found.append({r["key"]: [(m["d"], m["key"]) for m in r["near"]] for r in near.collect()})
        assert n == 160
    want = {}
    for i, k in enumerate(keys):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        want[k] = sorted((float(v), o) for v, o in zip(d, keys) if o != k)[:5]
    assert found[0] == want and found[1] == want


def test_mrmr_order():
    corr = np.array([[1, 0.9, 0.0], [0.9, 1, 0.1], [0.0, 0.1, 1]])
    assert [p for p, _g in mrmr.greedy_order([0.8, 0.7, 0.1], corr)] == [0, 2, 1]
    assert mrmr.greedy_order([0.8, 0.7, 0.1], corr)[2][1] == pytest.approx(0.7 - 0.5)


def test_ties_go_to_the_later_column(table):
    df, _x, _y, names = table
    flat = df.select(F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("pos")).distinct().withColumn("score", F.lit(float("nan")))
    assert [r["feature"] for r in suite.ranked(flat, names).orderBy("rank").collect()] == names[::-1]


def test_batched_newton_reaches_the_optimum(table):
    df, x, y, names = table
    data = logistic_input(df, "y", names, F.lit(1))
    batch = BatchLogistic(data, 3, 4)
    problems = [Problem((0, 2)), Problem((1,))]
    w = batch.fit(problems)
    xs = np.column_stack([x[:, [0, 2]], np.ones(180)])
    for h in range(3):
        t, s = (y == h).astype(float), np.where(y == h, 180 / (3 * (y == h).sum()), 1.0)
        p = 1 / (1 + np.exp(-xs @ w[0][h]))
        assert np.abs(xs.T @ (s * (p - t)) + w[0][h]).max() < 1e-3
    # no rows are held out here
    assert batch.confusion(problems, w).sum() == 0
    assert weighted_f1(np.diag([3, 4, 5])) == 1.0


@pytest.mark.parametrize("classes", [2, 3])
def test_subsets_that_share_products_are_fitted_as_each_alone(table, monkeypatch, classes):
    df, _x, _y, names = table
    df = df.withColumn("y", F.least("y", F.lit(classes - 1)))
    data = logistic_input(df, "y", names, F.lit(1) + F.when(F.col("a") > 0, 2).otherwise(0))
    problems = [Problem(f, r) for r in (0, 1) for f in ((0, 2), (1,), (0, 1, 2, 3), (3,), (2, 3))]
    shared = batch_logistic._shared_sums
    monkeypatch.setattr(batch_logistic, "PRODUCT_CELLS", 8 * 70 * 30)  # several chunks a batch
    blocks = BatchLogistic(packed(data, 4).persist(), classes, 4)
    w = blocks.fit(problems)
    x = np.random.default_rng(0).normal(size=(300, 4))
    member, y = np.arange(300) % 4, np.arange(300) % classes
    todo, weights = [(q.features, q.rows, v) for q, v in zip(problems, w)], blocks._weights
    heads = 1 if classes == 2 else classes
    got = shared(todo, heads, 1.0, weights, x, y, member)
    monkeypatch.setattr(batch_logistic, "SHARED_HEADS", 10**9)
    alone = BatchLogistic(data, classes, 4)
    for a, b in zip(w, alone.fit(problems)):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    assert (blocks.confusion(problems, w) == alone.confusion(problems, w)).all() and blocks.confusion(problems, w).sum() > 0
    assert all((alone._weights[b] == weights[b]).all() for b in (0, 1))
    want = []
    for f, r, v in todo:
        own = (member >> r) & 1 == 1
        xs = np.column_stack([x[own][:, f], np.ones(own.sum())])
        for h in range(heads):
            t = y[own] == (1 if heads == 1 else h)
            s = weights[r][y[own]] if heads == 1 else np.where(t, weights[r][h], 1.0)
            p = 1 / (1 + np.exp(-(xs @ v[h])))
            want += [xs.T @ (s * (p - t)), (xs.T @ (xs * (s * p * (1 - p))[:, None])).ravel()]
    assert np.allclose(got, np.concatenate(want))
    blocks.data.unpersist()


ALL = ["pearson", "RELIEFF", "lasso_c0.1", "elasticnet", "rf", "gbt", "lightgbm", "rfe", "rfecv", "boruta", "ga", "pso", "mi_rfe", "chi2_boruta", "nope"]
FAST = {"rf": {"trees": 5}, "gbt": {"rounds": 2, "depth": 2}, "boruta": {"rounds": 1, "trees": 5}, "ga": {"population": 6, "generations": 2}, "pso": {"particles": 6, "iterations": 2}}


def test_every_ranker_ranks_every_feature(table):
    df, _x, _y, names = table
    out = suite.run_suite("d", df, "y", "key", names, ALL, options=FAST).toPandas()
    assert set(out[out.status == "failed"].method) == {"nope"}
    ok = out[out.status == "ok"]
    for method, group in ok.groupby("method"):
        assert sorted(group["rank"]) == [1, 2, 3, 4] and set(group.feature) == set(names), method
        assert np.isfinite(group.score).all()
    # rankers without ties put the informative column before the constant
    rank = ok.pivot(index="method", columns="feature", values="rank").loc[["pearson", "RELIEFF", "rf", "gbt"]]
    assert (rank["a"] < rank["d"]).all()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 65, 1000])
def test_ranks_are_permuted(n):
    from featsieve.operators import shadows

    got = shadows.permuted(np.arange(n), n, 1, 2)
    assert sorted(got) == list(range(n)) and (n < 10 or (got != np.arange(n)).mean() > 0.7)
    assert n < 10 or (shadows.permuted(np.arange(n), n, 1, 3) != got).any()


def test_shadows_permute_the_whole_table(table):
    from featsieve.operators import shadows

    df, x, _y, names = table
    df = df.withColumn("b", F.when(F.col("b") > 1, None).otherwise(F.col("b")))
    found = []
    for parts in (1, 64):
        ranked, n = shadows.ranked_rows(df.repartition(parts), "y", "key", names, 1)
        assert n == 180 and sorted(r[0] for r in ranked.select("rank").collect()) == list(range(180))
        found.append(shadows.with_shadows(ranked, n, 4, 3, 1).orderBy("key").toPandas())
    a, b = found
    assert a.equals(b)
    for i in range(4):
        assert np.allclose(np.sort(a[f"s{i}"]), np.sort(a[f"f{i}"]), equal_nan=True)
    assert np.mean(a["s0"] != a["f0"]) > 0.9 and abs(np.corrcoef(a["s0"], a["f0"])[0, 1]) < 0.3 and abs(np.corrcoef(a["s0"], a["s2"])[0, 1]) < 0.3
    report = {r["feature"]: r for r in shadows.shadow_report(df, "y", "key", names, 1).collect()}
    assert all(r["unmatched"] == 0 and r["rows"] == 180 for r in report.values()) and report["a"]["shuffled"] and not report["d"]["shuffled"]


def test_c_values_are_read_from_names():
    assert suite._number_after_c("lasso_c0.01") == 0.01 and suite._number_after_c("elasticnet") == 1.0
    with pytest.raises(ValueError):
        suite.ranker("unknown")
