"""Whitening against numpy in exact numbers, on the given table and on edge rows."""

from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import queries, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


def brute(vectors):
    """x of every row; n, exact sums and covariance of the distinct ones, centred before multiplying."""
    x = [tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    y = [[n * v[k] - sums[k] for k in range(d)] for v in fit]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    return x, n, sums, cov


def check(got, ids, vectors, keep=4):
    x, n, sums, cov = brute(vectors)
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(-values)
    signs = {}
    assert len(got) == len(ids) * min(keep, len(cov))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for i, v in zip(ids, x, strict=True):
        y = np.array([n * a - s for a, s in zip(v, sums, strict=True)], float)
        for k in range(min(keep, len(cov))):
            r = by[i, k + 1].pop()
            e = values[order[k]]
            want = y @ columns[:, order[k]] / n / np.sqrt(e)
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
            assert r.explained == pytest.approx(e / np.trace(cov), rel=1e-9)
            assert r.identity_error < 1e-8
            if abs(want) > 1e-6:
                assert signs.setdefault(k, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-7)


def run(spark, rows, schema=VECTORS):
    df = spark.createDataFrame(rows, schema)
    models = whitening.fit(df)
    return whitening.component_rows(whitening.whiten(df, models), models, "vec_id").collect()


def test_given_table_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(queries.op13_embedding_whitening(spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_repeats_count_once_and_bad_vectors_take_no_part(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=6).astype(np.float32)]) for i in range(40)]
    good += [(100 + i, good[0][1]) for i in range(30)] + [(7, good[7][1])]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("-inf")] * 6), (204, [])]
    got = run(spark, good + bad)
    assert {r.vec_id for r in got} == {i for i, _ in good}
    check(got, [i for i, _ in good], [v for _, v in good])


def test_lengths_are_fitted_apart_and_flat_directions_are_null(spark):
    rng = np.random.default_rng(4)
    two = [(i, [float(v) for v in rng.normal(size=2)]) for i in range(20)]
    line = [(50 + i, [float(i), float(i), 0.0]) for i in range(9)]
    one = [(90, [1.0, 2.0, 3.0, 4.0, 5.0])]
    got = run(spark, two + line + one)
    check([r for r in got if r.vec_id < 50], [i for i, _ in two], [v for _, v in two])
    on_line = [r for r in got if 50 <= r.vec_id < 90]
    assert {r.component for r in on_line if r.whitened is not None} == {1} and len(on_line) == 27
    assert all(r.identity_error < 1e-8 for r in on_line)
    alone = [r for r in got if r.vec_id == 90]
    assert len(alone) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in alone)


def test_large_values_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=5) * 2.0 ** (4 * (i % 4))]) for i in range(60)]
    check(run(spark, rows, "vec_id long, embedding array<double>"), [i for i, _ in rows], [v for _, v in rows])
    z = rng.integers(-(2**61), 2**61, (50, 7))
    assert whitening.sum_of_squares(z) == [sum(int(v) ** 2 for v in column) for column in z.T]
    far = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [1.0, 3.0])]
    got = run(spark, far)
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 2)


def test_empty_table_and_further_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(i, [float(i), float(i * i)], 1.0, "k") for i in range(5)], VECTORS + ", whitened double, x string")
    out = whitening.whiten(df, whitening.fit(df))
    assert out.columns == ["vec_id", "embedding", "x", "whitened", "deviation"] and out.count() == 5
    assert {r.x for r in out.collect()} == {"k"}
