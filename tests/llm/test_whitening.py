import math

import numpy as np
import pytest
from gridloom.llm import whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def by_hand(vectors):
    """x, n, deviations, eigenvalues and unit vectors of a list of equally long vectors."""
    x = np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    deviations = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    c = (x - s // n) - (s % n) / n
    values, turns = np.linalg.eigh(c.T @ c / n)
    return c, n, deviations, values[::-1], turns[:, ::-1]


def check(got, ids, vectors, components):
    c, n, deviations, values, turns = by_hand(vectors)
    assert len(got) == len(ids) * components
    rows = {}
    for r in got:
        rows.setdefault(r["vec_id"], {})[r["component"]] = r
    w = np.array([[rows[i][k]["whitened"] for k in range(1, components + 1)] for i in ids])
    for at, i in enumerate(ids):
        assert all(r["n"] == n and r["deviation"] == deviations[at] and r["identity_error"] <= 1e-6 for r in rows[i].values())
    for k in range(components):
        assert rows[ids[0]][k + 1]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-10)
        want = c @ turns[:, k] / math.sqrt(values[k])
        assert min(abs(w[:, k] - want).max(), abs(w[:, k] + want).max()) < 1e-6
    assert abs(w.T @ w / n - np.eye(components)).max() < 1e-8


def test_against_numpy(spark, tables):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(400, 48)) * np.linspace(0.05, 3, 48)).astype(np.float32).tolist()
    path = tables(True, embeddings=(EMBEDDINGS, [(n, v, 0) for n, v in enumerate(vectors)]))
    check(whitening.op11_whitening(spark, path).collect(), list(range(400)), vectors, 32)


def test_the_given_table(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").collect()
    check(whitening.op11_whitening(spark, tiny).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 32)


def test_odd_rows(spark, tables):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(40, 6)).tolist()
    bad = [None, [], [None] * 6, [1.0, 2.0, None, 4.0, 5.0, 6.0], [math.nan] * 6, [math.inf, *[0.0] * 5], [-math.inf, *[0.0] * 5], [1.0] * 5, [1.0] * 7]
    path = tables(True, embeddings=(EMBEDDINGS, [(n, v, None) for n, v in enumerate(good)] + [(None if n % 2 else 100 + n, v, 0) for n, v in enumerate(bad)]))
    check(whitening.op11_whitening(spark, path).collect(), list(range(40)), good, 6)
    for few in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(n, [1.0, 2.0], 0) for n in range(5)]):
        assert whitening.op11_whitening(spark, tables(False, embeddings=(EMBEDDINGS, few))).collect() == []


def test_rank_and_repeated_rows(spark, tables):
    rng = np.random.default_rng(3)
    flat = (rng.integers(-200, 200, (60, 3)) @ rng.integers(-3, 4, (3, 20)) / 64).tolist()
    flat += flat[:1] * 30
    got = whitening.op11_whitening(spark, tables(False, embeddings=(EMBEDDINGS, [(n, v, 0) for n, v in enumerate(flat)]))).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    check(got, list(range(90)), flat, 3)


def test_large_numbers_stay_exact(spark, tables):
    rows = [[3e9 * (n % 7), -2e9 * (n % 5) + 1, float(n)] for n in range(50)]
    got = whitening.op11_whitening(spark, tables(False, embeddings=("vec_id long, embedding array<double>", [(n, v) for n, v in enumerate(rows)]))).collect()
    x = [[math.floor(64 * v) + 1_000_000 for v in row] for row in rows]
    s = [sum(c) for c in zip(*x)]
    for r in got:
        want = sum((50 * v - t) ** 2 for v, t in zip(x[r["vec_id"]], s))
        assert r["deviation"] == (want if want < 1 << 63 else None)


@pytest.mark.parametrize("d,block,limit", [(30, 4, None), (150, 8, 40), (60, 5, 24)])
def test_lanczos(d, block, limit):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = np.concatenate([[9.0] * 4, [5.0, 5.0], np.linspace(4, 1, 6), np.zeros(d - 12)])
    m = (q * values) @ q.T
    passes = []

    def apply(b):
        passes.append(b.shape[1])
        return m @ b

    found, vectors = whitening.lanczos(apply, d, 10, block, limit=limit)
    assert abs(found - values[:10]).max() < 1e-10 and abs(vectors.T @ vectors - np.eye(10)).max() < 1e-12
    assert np.linalg.norm(m @ vectors - vectors * found) < 1e-10
    assert max(passes) <= block and len(passes) < 40


def test_lanczos_in_a_small_invariant_space():
    """The starting block sees all that the map has after one step; breakdown must not end the search."""
    m = np.diag([3.0, 2.0, 1.0, *[0.0] * 20])
    found, _ = whitening.lanczos(lambda b: m @ b, 23, 8, 4)
    assert abs(found - np.array([3, 2, 1, 0, 0, 0, 0, 0])).max() < 1e-12
