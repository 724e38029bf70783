"""Whitening against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from docguard.llm.whitening import Centred, bidiagonalise, integer_vectors, packed, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, id int, x string, component int, n string"


def made(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, "n") for i, v in vectors], SCHEMA)


def fit_list(vectors, dims):
    ok = [(i, v) for i, v in vectors if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    return [i for i, _ in ok], [[math.floor(1024 * float(np.float32(e))) + 100000 for e in v] for _, v in ok]


def check(spark, vectors, dims, expected_components):
    ids, x = fit_list(vectors, dims)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * e - s) / n for e, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    exact = [sum((n * e - s) ** 2 for e, s in zip(row, sums)) for row in x]
    got = whiten(made(spark, vectors)).collect()
    assert len(got) == n * expected_components
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert sorted(k for k in found) == sorted(set(zip(ids, exact)), key=lambda k: k) if None not in ids else True
    for k in range(expected_components):
        mine = sorted((r.deviation, r.whitened) for r in got if r.component == k + 1)
        assert [d for d, _ in mine] == sorted(exact)
        assert all(r.n == n and r.identity_error <= 1e-9 and math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9)
                   for r in got if r.component == k + 1)
        if (k == 0 or values[k - 1] - values[k] > 1e-6 * values[0]) and (k + 1 == dims or values[k] - values[k + 1] > 1e-6 * values[0]):
            want = centred @ axes[:, k] / math.sqrt(values[k])
            mine = {(r.vec_id, r.deviation): r.whitened for r in got if r.component == k + 1}
            top = int(np.argmax(np.abs(want)))
            sign = 1 if mine[ids[top], exact[top]] * want[top] > 0 else -1
            assert all(abs(sign * mine[i, d] - w) < 1e-8 for i, d, w in zip(ids, exact, want))
    # the covariance, recomputed from what came back
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, r.whitened)
    counts = {}
    for i, d in zip(ids, exact):
        counts[i, d] = counts.get((i, d), 0) + 1
    w = np.array([[rows[key][k + 1] for k in range(expected_components)] for key, c in counts.items() for _ in range(c)])
    w = w - w.mean(0)
    assert np.abs(w.T @ w / n - np.eye(expected_components)).max() < 1e-9


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    mixed = rng.standard_normal((300, 12)) * np.linspace(2, .2, 12) @ np.linalg.qr(rng.standard_normal((12, 12)))[0]
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(mixed)]
    rows += [(1, rows[1][1]), (2, rows[5][1]), (None, rows[7][1]), (900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12),
             (904, [1.0] * 11 + [float("inf")]), (905, [1.0] * 5), (906, [0.0] * 12)]
    return rows


def test_whiten(spark, vectors):
    check(spark, vectors, 12, 8)


def test_equal_variances_and_flat_directions(spark):
    """Two equal variances are two components; directions without variance are none."""
    rows = []
    for i, (a, b, c) in enumerate([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 3), (0, 0, -3)] * 4):
        rows.append((i, [float(a), float(b), float(c), 2.0, 5.0]))
    check(spark, rows, 5, 3)


def test_few_or_no_vectors(spark):
    assert whiten(made(spark, [])).collect() == []
    assert whiten(made(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(made(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whiten(made(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    got = whiten(made(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 12)) for r in got) == [(1, 1, 2048 ** 2, 1.0), (2, 1, 2048 ** 2, 1.0)]


def test_long_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit"):
        whiten(made(spark, [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [3.0, 4.0])])).collect()


def test_exact_beyond_doubles(spark):
    vectors = [(i, [float(10000 * (i % 7)), float(i)]) for i in range(20)]
    check(spark, vectors, 2, 2)


def test_bidiagonal_factors(spark, vectors):
    """V is orthonormal and X'X = V B'B V'."""
    ids, x = fit_list(vectors, 12)
    whole = integer_vectors(made(spark, vectors)).filter("size(x) = 12")
    table = Centred(whole, 12, packed(whole, 12))
    rights, alphas, betas = bidiagonalise(table)
    centred = np.array(x, float) - np.mean(np.array(x, float), 0)
    gram = centred.T @ centred / len(x)
    small = np.diag(alphas) + np.diag(betas[1:], 1)
    assert np.abs(rights @ rights.T - np.eye(12)).max() < 1e-13
    assert np.abs(rights.T @ small.T @ small @ rights - gram).max() < 1e-9 * np.abs(gram).max()
