import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from lexforge.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>"


def exact(vectors):
    """n, S, x and the covariance as fractions, by plain loops."""
    xs = [[max(-(2**62), min(2**62, math.floor(Fraction(c) * 1024))) + 100000 for c in v] for v in vectors]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n for j in range(d)] for i in range(d)]
    return n, sums, xs, cov


def verify(rows, found, most=8):
    good = [(i, v) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v))]
    n, sums, xs, cov = exact([v for _, v in good])
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {}
    for r in found:
        assert r.n == n and r.identity_error <= 1e-4
        by.setdefault(r.component, []).append(r)
    trace = float(sum(cov[i][i] for i in range(len(cov))))
    for k, some in by.items():
        assert len(some) == len(good)
        want = sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(x, sums)), float(sum(Fraction(n * c - s, n) * Fraction(e) for c, s, e in zip(x, sums, vectors[:, k - 1]))) / math.sqrt(values[k - 1])) for (i, _), x in zip(good, xs))
        got = sorted((str(r.vec_id), int(r.deviation), r.whitened) for r in some)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        a, b = np.array([x[2] for x in got]), np.array([x[2] for x in want])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-6 * max(1, abs(b).max())
        assert all(abs(r.explained / (values[k - 1] / trace) - 1) < 1e-4 for r in some)
    return by


def vectors(seed, n, d):
    rng = random.Random(seed)
    scale = [2.0 / (k + 1) for k in range(d)]
    return [(i, [rng.gauss(0, s) + 0.3 for s in scale]) for i in range(n)]


def test_random_vectors_match_fractions(spark):
    rows = vectors(1, 120, 12)
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(verify(rows, found)) == list(range(1, 9))


def test_odd_rows_are_dropped_or_kept_as_stated(spark):
    rows = vectors(2, 40, 3)
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan")] * 3), (103, [1.0, float("inf"), 0.0]), (104, [0.0, 0.0, float("-inf")])]
    same = [(None, rows[0][1]), (None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1])]
    ragged = [(200, [1.0, 2.0]), (201, [])]
    docs = spark.createDataFrame(rows + odd + same + ragged, SCHEMA).selectExpr("*", "1 AS vector", "2 AS n", "3 AS white")
    found = whitening.whiten(docs).collect()
    assert sorted(verify(rows + odd + same, found)) == [1, 2, 3]


@pytest.mark.parametrize("size", [1e5, 1e12, 1e18, 1e30])
def test_large_numbers_stay_exact(spark, size):
    """Several digits a number; products far beyond 2^53, deviations beyond 64 bits; at last saturation."""
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-size, size), rng.uniform(-1, 1) * size, rng.uniform(-1, 1)]) for i in range(30)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    if size > 1e17:
        n, sums, xs, _ = exact([v for _, v in rows])
        far = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for (i, _), x in zip(rows, xs)}
        assert {r.vec_id: r.deviation and int(r.deviation) for r in found} == {i: v if v < 10**38 else None for i, v in far.items()}
    else:
        verify(rows, found)


def test_gram_sums_are_exact():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-(2**62), 2**62, (50, 3)), rng.integers(-5, 5, (5, 3)), np.array([[2**62 + 100000, -(2**62) + 100000, 0]])])
    made = whitening.products(x)
    full = np.column_stack([x.astype(object), np.ones(len(x), dtype=object)])
    total = sum((v.astype(object) << (whitening.DIGIT_BITS * p) for p, v in made.items()), start=np.zeros((4, 4), dtype=object))
    assert (total == full.T.dot(full)).all()


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0, float(i * i)]) for i in range(20)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted({r.component for r in found}) == [1, 2] and found[0].identity_error < 1e-4


def test_query_matches_fractions(spark):
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.001/embeddings.parquet'").fetchall()
    rows = [(i, [float(c) for c in v]) for i, v in rows]
    found = queries.op13_whitening(spark, "/root/testdata/sf0.001").collect()
    assert dict(queries.op13_whitening(spark, "/root/testdata/sf0.001").dtypes)["deviation"] == "bigint"
    assert sorted(verify(rows, found)) == list(range(1, 9))
