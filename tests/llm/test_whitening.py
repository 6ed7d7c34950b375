"""Whitening against whole numbers in Python and numpy's covariance."""

import numpy as np
import pytest

from vespera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, index int, part int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 7, "clash", 3, 4) for i, v in vectors], SCHEMA).repartition(3)


def direct(vectors, components=8):
    x = [[int(np.floor(1024.0 * float(np.float32(c)))) + 100_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    c = np.array([[r[j] - sums[j] / n for j in range(d)] for r in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    return n, deviation, c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize(("dim", "rows", "block"), [(12, 300, 16), (5, 40, 1024), (12, 6, 4)])
def test_whitened_rows_match_numpy(spark, monkeypatch, dim, rows, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rng = np.random.default_rng(dim)
    data = (rng.normal(size=(rows, dim)) * np.linspace(3, 0.2, dim)).astype("f4")
    good = [(i, v.tolist()) for i, v in enumerate(data)]
    good += [(3, good[3][1]), (None, good[0][1])] + [(900 + i, good[1][1]) for i in range(rows // 3)]  # repeats
    bad = [(1000, None), (1001, []), (1002, [None] * dim), (1003, [float("nan")] * dim), (1004, [float("inf")] * dim), (1005, [1.0] * (dim + 1))]
    n, deviation, white, share = direct(good)
    got = whitening.whiten(table(spark, good + bad)).collect()
    k = white.shape[1]
    assert len(got) == len(good) * k
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-6
    key = lambda i: -1 if i is None else i
    by = {}
    for r in got:
        by.setdefault(r.component, []).append((key(r.vec_id), int(r.deviation), r.whitened))
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-6
    for c, found in by.items():
        want = sorted((key(i), dv, w) for (i, _), dv, w in zip(good, deviation, white[:, c - 1]))
        found.sort()
        assert [f[:2] for f in found] == [w[:2] for w in want]
        a, b = np.array([f[2] for f in found]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6  # either sign


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whitening.whiten(table(spark, [(0, None), (1, [float("nan")])])).count() == 0
    one = whitening.whiten(table(spark, [(0, [0.0, 1.0]), (1, [0.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9)), r.explained) for r in one) == [(0, 1, 1.0, 1.0), (1, 1, 1.0, 1.0)]


def test_deviation_is_exact_beyond_longs(spark):
    vectors = [(0, [0.0, 2.0**40]), (1, [2.0**41, 1.0]), (2, [1.0, -(2.0**41)])]
    _, deviation, _, _ = direct(vectors)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(table(spark, vectors)).collect()}
    assert got == dict(enumerate(deviation)) and max(deviation) > 2**63
