import math

import numpy as np
import pytest

from chatterscope.llm import whitening

INF = float("inf")


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component string, n int").repartition(parts)


def rows_of(vectors):
    return [(k if k % 7 else None, v, k, "x", 3) for k, v in enumerate(vectors)]


def check(spark, vectors, good, most=32):
    """good: the vectors that stay, in whole numbers by the contract."""
    got = whitening.whitened(table(spark, rows_of(vectors)), most=most).collect()
    x = np.array(good, object)
    n, s = len(good), [sum(c) for c in zip(*good, strict=True)]
    y = np.array([[float(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in good])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > e[0] * 1e-11).sum())) if e[0] > 0 else 0
    assert len(got) == n * k
    assert sorted({r.component for r in got}) == list(range(1, k + 1))
    assert all(r.n == n and r.identity_error <= 1e-6 for r in got)
    assert all(abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-6 * r.explained for r in got)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x.tolist()]
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    for c in range(k):
        want = np.sort(np.abs(y @ u[:, c] / np.sqrt(e[c])))
        gap = min(abs(e[c] - e[d]) for d in range(len(e)) if d != c) / e[0] if len(e) > 1 else 1
        if gap > 1e-6:
            found = np.sort([abs(r.whitened) for r in got if r.component == c + 1])
            assert np.allclose(found, want, atol=1e-5)


def whole(vectors):
    return [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]


def test_against_a_dense_solver(spark):
    rnd = np.random.default_rng(5)
    for d, n, most in ((40, 300, 32), (7, 60, 32), (12, 9, 5)):
        clean = (rnd.normal(size=(n, d)) * np.geomspace(9, 0.2, d) + rnd.normal(size=d) * 20).astype(np.float32).tolist()
        clean += clean[:3]  # repeated vectors count each time
        bad = [None, [None] * d, [*clean[0][:-1], float("nan")], [INF, *clean[0][1:]], [-INF, *clean[0][1:]], [*clean[1][:-1], None], clean[0][:-1], [], clean[0] + [1.0]]
        check(spark, clean + bad, whole(clean), most)


def test_constant_dimensions_ranks_and_ties(spark):
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(80, 3)) @ rnd.normal(size=(3, 9))
    vectors = np.hstack([np.round(base * 64) / 64, np.full((80, 2), 7.25), np.zeros((80, 1))]).astype(np.float32).tolist()
    check(spark, vectors, whole(vectors))
    square = [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]]  # both components explain half
    got = whitening.whitened(table(spark, rows_of(square))).collect()
    assert len(got) == 8 and all(r.explained == pytest.approx(0.5) and r.identity_error < 1e-12 for r in got)


def test_nothing_to_whiten(spark):
    for vectors in ([], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        assert whitening.whitened(table(spark, rows_of(vectors), 2)).count() == 0


def test_large_entries_and_deviations(spark):
    big = [[1e30, 1.0], [-1e30, 2.0], [5.0, 3.0]] * 200
    got = whitening.whitened(table(spark, rows_of(big))).collect()
    n = 600
    x = [[math.floor(64 * min(max(c, -whitening.BOUND), whitening.BOUND)) + 1_000_000 for c in v] for v in big]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    assert sorted(map(str, [w if w < 1 << 63 else None for w in want])) == sorted(str(r.deviation) for r in got if r.component == 1)
    assert all(r.identity_error < 1e-6 for r in got)


def test_parts_change_nothing(spark):
    rnd = np.random.default_rng(8)
    rows = [(k, v) for k, v in enumerate(rnd.normal(size=(500, 10)).astype(np.float32).tolist())]
    found = []
    for parts in (1, 9):
        got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts))
        found.append(sorted((r.vec_id, r.component, r.deviation, r.explained, r.whitened) for r in got.collect()))
    # All but the last rounding of a projection is exact, whatever the batches.
    assert [r[:4] for r in found[0]] == [r[:4] for r in found[1]]
    assert np.allclose([r[4] for r in found[0]], [r[4] for r in found[1]], rtol=0, atol=1e-13)


def test_factor_and_rotations():
    rnd = np.random.default_rng(9)
    for d, rank in ((30, 30), (30, 4), (1, 1)):
        x = rnd.normal(size=(100, rank)) @ rnd.normal(size=(rank, d))
        v = x.T @ x
        factor, order = whitening.cholesky(v)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v[np.ix_(order, order)])
        assert np.allclose(np.triu(factor[:rank], 1), 0)
        values, vectors = whitening.components(v)
        assert np.allclose(v @ vectors, vectors * values, atol=1e-9 * values[0]) and np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
    pairs = [set(zip(i.tolist(), j.tolist(), strict=True)) for i, j in whitening.rounds(7)]
    assert sum(map(len, pairs)) == 21 == len({frozenset(p) for r in pairs for p in r})
