"""Operator 11 against exact integers and numpy's eigenvectors."""

import math

import numpy as np
import pytest

from featsieve.llm import whitening


def reference(vectors, k):
    """(n, exact deviations, eigenvalues, vectors, trace, centred rows) of lists of floats."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.asarray([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, values[::-1][:k], turn[:, ::-1][:, :k], values.sum(), centred


def compare(got, ids, vectors, k=32, sign_tolerance=1e-9):
    n, deviation, values, turn, trace, centred = reference(vectors, k)
    k = len(values)
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(table) == sorted(ids) and len(got) == len(ids) * k
    whitened = np.asarray([[table[i][c].whitened for c in range(1, k + 1)] for i in ids])
    want = centred @ turn / np.sqrt(values)
    sign = np.sign((whitened * want).sum(0))
    assert np.abs(whitened - want * sign).max() < sign_tolerance
    for i, d in zip(ids, deviation):
        for c in range(1, k + 1):
            r = table[i][c]
            assert (r.n, r.deviation) == (n, d) and abs(r.explained * trace / values[c - 1] - 1) < 1e-9
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_against_numpy(spark, parts):
    rng = np.random.default_rng(1)
    spread = np.linspace(3, 0.2, 60)
    good = [(i, (rng.normal(size=60) * spread).astype(np.float32).tolist()) for i in range(400)]
    good += [(900 + i, good[0][1]) for i in range(30)]  # equal vectors
    bad = [(-1, None), (-2, [1.0] * 59 + [float("nan")]), (-3, [float("inf")] + [0.0] * 59), (-4, [None] + [0.0] * 59), (-5, []), (-6, [1.0])]
    table = frame(spark, good + bad).selectExpr("*", "1 as n", "'x' as component", "2 as `a.b`", "3 as x").repartition(parts)
    compare(whitening.whitened_rows(table).collect(), [i for i, _ in good], [v for _, v in good])


def test_partial_sums_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PARTIALS_BYTES", 1)
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(90)]
    vectors = whitening.integer_vectors(frame(spark, good)).repartition(30, "vec_id")
    model = whitening.fit(vectors, 4)
    compare(whitening.whiten(vectors, model).collect(), list(range(90)), [v for _, v in good], 4)


def test_small_and_degenerate_tables(spark):
    assert whitening.whitened_rows(frame(spark, [])).count() == 0
    assert whitening.whitened_rows(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened_rows(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    two = [(1, [1.0, 5.0]), (2, [3.0, 5.0]), (None, [8.0, 5.0]), (2, [3.0, 5.0])]  # one dimension has no variance
    got = whitening.whitened_rows(frame(spark, two)).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and {r.vec_id for r in got} == {1, 2, None}
    n, deviation, *_ = reference([v for _, v in two], 1)
    assert sorted(r.deviation for r in got) == sorted(deviation) and all(abs(r.explained - 1) < 1e-12 for r in got)


def test_large_entries_are_exact_or_refused(spark):
    big = [(i, [float(2.0**9 * i), float(i % 3)]) for i in range(20)]
    compare(whitening.whitened_rows(frame(spark, big)).collect(), list(range(20)), [v for _, v in big])
    x, zero = np.asarray([[10**9, 0], [0, 5]]), np.zeros(2, np.int64)
    assert whitening._deviations(x, 3, zero, zero).tolist() == [9 * 10**18, 225]
    with pytest.raises(OverflowError):
        whitening._deviations(x, 4, zero, zero)


SPECTRA = {
    "flat": np.linspace(1, 2, 300), "dominated": np.concatenate([[1e6], np.linspace(67, 48, 63)]), "falling": 2.0 ** -np.arange(60),
    "gap": np.concatenate([np.linspace(100, 20, 40), np.linspace(1, 0, 300)]), "few": np.asarray([2.0, 1.0])}


@pytest.mark.parametrize("name", SPECTRA)
def test_components_are_certified(name):
    rng = np.random.default_rng(3)
    values = SPECTRA[name]
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    found, turn, certificate = whitening.leading(lambda b: v @ b, len(v), 32)
    k = min(32, len(v))
    assert np.abs(found - np.sort(values)[::-1][:k]).max() <= 1e-13 * values.max()
    assert np.linalg.norm(v @ turn - turn * found, axis=0).max() <= 1e-13 * values.max() and np.abs(turn.T @ turn - np.eye(k)).max() < 1e-12
    assert certificate["residual"] <= whitening.TOLERANCE


def test_filter_is_the_chebyshev_polynomial():
    values = np.linspace(0, 3, 13)
    got = whitening.filtered(lambda b: values[:, None] * b, np.ones((13, 1)), values[:, None], 0.2, 1.0, 2.5, 6)[:, 0]
    t = lambda x: np.polynomial.chebyshev.chebval((x - 0.6) / 0.4, [0] * 6 + [1])
    assert np.allclose(got, t(values) / t(2.5), rtol=1e-10)


def test_query_on_the_given_table(spark, data):
    from featsieve.llm import QUERIES

    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    compare(QUERIES["op11_chebyshev_whitening"](spark, data).collect(), [i for i, _ in rows], [v for _, v in rows], sign_tolerance=1e-8)
