"""Whitening against exact rational sums and dense linear algebra."""

from fractions import Fraction

import numpy as np
import pytest

from creatorlake.llm import QUERIES, whitening

FIELDS = "vec_id long, embedding array<double>, component string, x int, n string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, "clash", 1, "y") for k, v in enumerate(vectors)], FIELDS)


@pytest.mark.parametrize("spectrum", [
    [5, 4, 3, 2, 1], [1, 1, 1, 1], [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.5, 0.5], [1e6, 1, 1 + 1e-13, 1e-6], [1 + 1e-7, 1, 1 - 2e-7] + [0.1] * 20,
    list(np.geomspace(1, 1e-12, 48)), [1, 0, 0, 0], [0, 0]])
def test_refined_eigenvectors_are_beyond_double_precision(spectrum):
    d, wide = len(spectrum), np.longdouble
    q = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0].astype(wide)
    for _ in range(4):
        q = q + q @ (np.eye(d, dtype=wide) - q.T @ q) / 2
    a = (q * np.array(spectrum, wide)) @ q.T
    a = (a + a.T) / 2
    values, x = whitening.refined(a)
    assert (np.diff(values) <= 0).all()
    assert np.abs(a @ x - x * values).max() <= 1e-17 * max(spectrum) and np.abs(x.T @ x - np.eye(d)).max() < 1e-17


def exact(vectors):
    """n, sums and covariance of the distinct whole vectors, as fractions."""
    rows = sorted(set(vectors))
    n, d = len(rows), len(rows[0])
    sums = [sum(r[i] for r in rows) for i in range(d)]
    centred = [[Fraction(r[i]) - Fraction(sums[i], n) for i in range(d)] for r in rows]
    return n, sums, [[sum(c[i] * c[j] for c in centred) / n for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("size", [1.0, 1e9, 1e15])
def test_moments_are_exact(spark, size):
    rng = np.random.default_rng(3)
    vectors = [tuple(int(v) for v in rng.normal(size=3) * 100 * size + 70 * size) for _ in range(60)]
    distinct = spark.createDataFrame([(list(v),) for v in set(vectors)], "x array<long>").repartition(5)
    held = whitening.moments(distinct)
    n, sums, covariance = exact(vectors)
    assert (held.n, held.sums) == (n, sums)
    assert [[Fraction(v, n * n) for v in row] for row in held.spread] == covariance
    for got, want in zip(held.covariance().ravel(), [v for row in covariance for v in row]):
        hi, lo = float(got), float(got - np.longdouble(float(got)))
        assert abs(Fraction(hi) + Fraction(lo) - want) <= abs(want) * Fraction(1, 1 << 62)


def check(got, vectors, components=4):
    """Every row against dense linear algebra over the distinct vectors."""
    whole = {k: tuple(int(np.floor(256 * c)) for c in v) for k, v in vectors.items()}
    n, sums, covariance = exact(whole.values())
    values, basis = np.linalg.eigh(np.array(covariance, float))
    values, basis = values[::-1], basis[:, ::-1]
    shown = {}
    for r in got:
        assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(whole[r["vec_id"]], sums))
        assert r["identity_error"] < 1e-9 and abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9
        shown.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    assert sorted(shown) == list(range(1, min(components, len(sums)) + 1))
    for k, cells in shown.items():
        want = {i: sum((c - s / n) * b for c, s, b in zip(whole[i], sums, basis[:, k - 1])) / values[k - 1] ** 0.5 for i in whole}
        sign = np.sign(sum(cells[i] * want[i] for i in want))
        assert cells.keys() == want.keys() and max(abs(sign * cells[i] - want[i]) for i in want) < 1e-7


def test_irregular_rows(spark):
    rng = np.random.default_rng(8)
    good = [(rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]).tolist() for _ in range(80)]
    good += [good[3]] * 40
    bad = [None, [], [1.0] * 5, [None] + [1.0] * 5, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [float("-inf")] + [0.0] * 5]
    got = whitening.whiten(frame(spark, good + bad))
    assert got.columns == ["vec_id", "embedding", "x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), dict(enumerate(good)))
    assert whitening.whiten(frame(spark, bad[:2])).count() == 0 and whitening.whiten(frame(spark, []).limit(0)).count() == 0
    check(whitening.whiten(frame(spark, [g[:2] for g in good])).collect(), dict(enumerate(g[:2] for g in good)))


def test_no_variance_and_sums_beyond_64_bits(spark):
    rows = whitening.whiten(frame(spark, [[1.0, 2.0]] * 5)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows] == \
        [(k, 1, 0, 0.0, 0.0, 1.0) for k in (1, 2)] * 5
    rows = whitening.whiten(frame(spark, [[1e14, 0.0], [0.0, 1.0], [3.0, 1.0]])).collect()
    assert {r["deviation"] for r in rows} == {None} and len(rows) == 6


def test_query(spark, sf_dir):
    vectors = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()}
    check(QUERIES["op13_embedding_whitening"](spark, sf_dir).collect(), vectors)
