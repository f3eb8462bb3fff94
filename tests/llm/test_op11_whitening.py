from fractions import Fraction

import numpy as np
import pytest

from rentlens.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(rows):
    """x of each usable row, and the fit list's number, sums and covariance, by plain Python."""
    x = {i: [int(np.floor(256.0 * float(c))) for c in v] for i, v in rows
         if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    every = sorted({tuple(v) for v in x.values()})
    n, d = len(every), len(every[0])
    sums = [sum(v[j] for v in every) for j in range(d)]
    z = [[n * v[j] - sums[j] for j in range(d)] for v in every]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n ** 3)) for j in range(d)] for i in range(d)])
    return x, n, sums, cov


def test_query_against_brute_force(spark):
    got = queries.QUERIES["op11_whitening"](spark, SF).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x, n, sums, cov = brute(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(x) and (got.n == n).all()
    assert np.allclose(got.explained, values[got.component - 1] / np.trace(cov), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    plain = (np.array([x[i] for i in wide.index]) - np.array(sums) / n) @ axes[:, :4] / np.sqrt(values[:4])
    for c in range(4):
        sign = np.sign((plain[:, c] * wide[c + 1]).sum())
        assert np.allclose(plain[:, c] * sign, wide[c + 1], atol=1e-8)
    for r in got[got.component == 1].itertuples():
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums)) == int(r.deviation_digits)


@pytest.mark.parametrize("gaps", [[5, 4, 3, 2, 1, .5], [1, 1, 1, .5, .5, .25], [1, 1 + 1e-9, 1 + 2e-9, .5, .5 + 1e-12, 0], [1, 1e-3, 1e-6, 1e-9, 0, 0]])
def test_refinement_tells_clustered_eigenvalues_apart(gaps):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal in longdouble
        q = q @ (1.5 * np.eye(6, dtype=np.longdouble) - 0.5 * (q.T @ q))
    want = np.sort(np.array(gaps, np.longdouble))[::-1]
    a = q @ np.diag(np.array(gaps, np.longdouble)) @ q.T
    values, x = whitening.eigenvectors((a + a.T) / 2)
    assert np.abs(values - want).max() < 1e-17 * 8
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-17 * 8
    off = x.T @ (a @ x) - np.diag(values)
    assert np.abs(off).max() < 1e-17 * 8  # single precision alone leaves 1e-7, double 1e-16
    for i, v in enumerate(gaps):
        if min(abs(v - w) for j, w in enumerate(gaps) if j != i) > 1e-13:  # a simple eigenvalue has one vector
            at = int(np.abs(values - np.longdouble(v)).argmin())
            assert abs(abs(float(q[:, i] @ x[:, at])) - 1) < 1e-12
            assert np.abs(np.abs(q[:, i]) - np.abs(x[:, at])).max() < 1e-6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5], 7), (2, [1.0, 2.0, 0.5], 7), (2, [1.0, 2.0, 0.5], 7), (3, None, 7), (4, [1.0, None, 2.0], 7),
            (5, [nan, 1.0, 1.0], 7), (6, [inf, 1.0, 1.0], 7), (None, [-0.001, 0.0, -0.0], 7), (8, [3.0], 7), (9, [3.0, 0.0, 0.0], 7), (10, [], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int")
    model = whitening.fit(df)
    out = whitening.whitened(df, model).toPandas()
    assert model.n == 4 and len(model.roots) == 2 and len(out) == 7 * 2  # short ones count as filled up with 0
    assert (out[out.vec_id == 8].whitened.to_numpy() == out[out.vec_id == 9].whitened.to_numpy()).all()
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whitened(same, whitening.fit(same)).count() == 0
    empty = spark.createDataFrame([], df.schema)
    assert whitening.whitened(empty, whitening.fit(empty)).count() == 0


def test_great_numbers_stay_exact(spark):
    rows = [(i, [float(2 ** 40 + i * 2 ** 33), float(-(2 ** 52) * (i % 3)), 1e300 if i == 7 else float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    x = {i: [min(2 ** 63 - 1, int(256 * c)) for c in v] for i, v in rows}
    sums = [sum(v[j] for v in x.values()) for j in range(3)]
    assert model.n == 40 and model.sums == sums
    for r in whitening.whitened(df, model).filter("component = 1").collect():
        want = sum((40 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert int(r.deviation_digits) == want and r.deviation == (want if want < 2 ** 63 else None)


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = whitening.fit(df.repartition(1)), whitening.fit(df.unionByName(df).repartition(13))
    assert a.n == b.n and a.sums == b.sums and (a.axes == b.axes).all() and (a.roots == b.roots).all()
