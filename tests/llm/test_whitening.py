import math

import numpy as np
import pytest

from sightline.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("seed,n", [(0, 1), (1, 2), (2, 7), (3, 40), (4, 64)])
def test_polar_factor_is_orthogonal_and_symmetric(seed, n):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, n))
    a = a + a.T
    u = whitening.polar_factor(a)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(u @ u - np.eye(n)).max() < 1e-12
    assert np.abs(u - (vectors * np.sign(values)) @ vectors.T).max() < 1e-10


SPECTRA = {
    "spread": np.logspace(0, -10, 40),
    "near": 1 + 1e-6 * np.arange(40),
    "ties": np.repeat([5.0, 3.0, 1.0, 0.5], 10),
    "equal": np.full(12, 2.5),
    "rank two": np.concatenate([[4.0, 1.0], np.zeros(20)]),
    "one": np.array([3.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components_match_a_general_eigensolver(name):
    values = SPECTRA[name]
    n = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((n, n)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.spectral_components(a)
    expected = np.linalg.eigvalsh(a)[::-1]
    assert np.abs(got - expected).max() <= 1e-13 * np.abs(expected).max() * n
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() <= 1e-13 * np.abs(expected).max() * n
    few, some = whitening.spectral_components(a, 3)
    assert len(few) == min(3, n) and np.abs(few - expected[:3]).max() <= 1e-13 * np.abs(expected).max() * n


def vectors(seed=0, n=300, d=24):
    rng = np.random.default_rng(seed)
    raw = rng.standard_normal((n, d)) @ np.diag(np.linspace(2, 0.2, d)) + rng.standard_normal(d)
    return raw.astype(np.float32)


def brute(rows, k):
    """Every step of the contract in plain numpy and Python integers."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    xs = [tuple(math.floor(64 * float(v)) + 1_000_000 for v in r[1]) for r in kept]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in fit])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    out = {}
    for r, x in zip(kept, xs):
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        white = np.array([(n * v - s) / n for v, s in zip(x, sums)]) @ basis / np.sqrt(values)
        out[r[0]] = n, deviation, white
    return out, values / np.trace(centred.T @ centred / n)


def test_digest_matches_brute_force(spark):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors())]
    rows += [(1000 + i, rows[0][1], 2) for i in range(200)]  # copies count once in the fit
    rows += [(2000, None, 1), (2001, [None] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [float("inf")] * 24, 1)]
    got = whitening.whitening_digest(spark.createDataFrame(rows, SCHEMA).repartition(5), 6).collect()
    expected, explained = brute(rows, 6)
    assert len(got) == 6 * len(expected) and {r.component for r in got} == set(range(1, 7))
    assert {r.n for r in got} == {300}
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        n, deviation, white = expected[r.vec_id]
        assert r.deviation == deviation
        sign = signs.setdefault(r.component, math.copysign(1, r.whitened * white[r.component - 1]))
        assert abs(r.whitened - sign * white[r.component - 1]) < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_whole_rows_keep_clashing_columns(spark):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors(n=40, d=5))] + [(None, None, None), (None, [0.5] * 5, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'w' as whitened", "map('a', 1) as `odd ``name`")
    model = whitening.fit_whitening(df, 4)
    out = whitening.whiten(df, model)
    assert out.columns == df.columns + ["whitened_1"]
    got = out.collect()
    assert len(got) == 41 and {r.whitened for r in got} == {"w"}
    assert all(len(r.whitened_1.components) == 4 for r in got)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, 0)],
        [(1, [], 0), (2, [], 0)],
        [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)],
    ],
)
def test_nothing_to_whiten(spark, rows):
    out = whitening.whitening_digest(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.collect() == []


def test_rank_deficient_odd_lengths_and_large_entries(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(20)] + [(90, [1.0, 2.0], 0), (91, [], 0)]
    got = whitening.whitening_digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and len(got) == 20
    assert got[0].identity_error < 1e-9
    rows = [(i, [float(i), 1e30 * (-1) ** i], 0) for i in range(6)]
    got = whitening.whitening_digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.deviation for r in got} == {None} and len(got) >= 6


def test_exact_deviation_of_large_numbers():
    x = np.array([[1 << 40, 5], [3, -(1 << 41)]])
    sums = [int(s) for s in x.sum(axis=0)]
    plain = [sum((2 * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
    assert [int(v) for v in whitening.exact_deviation(x, 2, sums)] == plain
