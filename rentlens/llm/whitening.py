"""Whitening of embeddings by eigenvectors that are refined from single precision.

Vectors are quantised to whole numbers, x = floor(256 c), so sums and products of them are exact: tasks add up
x and the products of x - m, with m the mean rounded to whole numbers, and Spark adds the tasks' sums as limbs
of 32 bits. The covariance V = K / n^2 is then known as whole numbers K; n x n numbers of one vector length,
whatever the number of rows, come to the driver.

Eigenvectors start from the single-precision ones and are corrected by Ogita and Aishima's iteration: with
R = I - X'X, S = X'AX and l = diag(S) / (1 - diag(R)), X becomes X + XE, where E = (S + R l) / (l_j - l_i) for
eigenvalues further apart than the residuals allow to tell, and R / 2 for others. Products are in numpy's
longdouble (64 bits of mantissa on x86). Eigenvalues that cannot be told apart form a cluster; the matrix
minus the cluster's mean, restricted to the cluster's vectors, is solved by itself and the vectors are turned
by the result, which tells them apart in the next iteration. Truly equal eigenvalues keep any basis.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.llm.common import ids_like, saved, workers

SCALE, LIMBS, ROUNDS = 256, 6, 40
REAL = np.longdouble
#: Whole numbers below this are squared and added as they are; greater ones as Python's integers.
SMALL = 1 << 24


def usable(col: Column) -> Column:
    """Vectors without null and non-finite entries."""
    return F.coalesce(F.forall(col, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def quantised(vectors: DataFrame, vec_col: str) -> Column:
    """floor(256 c) of each entry, as long (entries beyond the longs count as the last one)."""
    return F.transform(F.col(vec_col), lambda c: F.floor(c.cast("double") * float(SCALE)).cast("long"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of longs as rows of ``d`` entries, shorter ones filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offs)
    if (size == d).all():
        return flat[offs[0]:offs[-1]].reshape(len(column), d)
    out = np.zeros((len(column), d), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(offs[0], offs[-1]) - offs[:-1][row]] = flat[offs[0]:offs[-1]]
    return out


def limbs(values: list[int]) -> np.ndarray:
    """Each integer as LIMBS numbers of 32 bits, the last one with the sign."""
    return np.array([[v >> 32 * k & 0xFFFFFFFF for k in range(LIMBS - 1)] + [v >> 32 * (LIMBS - 1)] for v in values],
                    np.int64).reshape(len(values), LIMBS)


def _limb_rows(values: list[int]) -> pa.RecordBatch:
    parts = limbs(values)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), *map(pa.array, parts.T)],
                                      ["cell", *(f"l{k}" for k in range(LIMBS))])


LIMB_SCHEMA = "cell int, " + ", ".join(f"l{k} long" for k in range(LIMBS))


def _exact_sums(partial: DataFrame) -> list[int]:
    """The sums by cell; the number of cells depends on the length of vectors alone."""
    rows = partial.groupBy("cell").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    return [sum(r[f"l{k}"] << 32 * k for k in range(LIMBS)) for r in sorted(rows, key=lambda r: r["cell"])]


def _sum_rows(d: int):
    def run(batches):
        total = np.zeros(d + 1, object)
        for batch in batches:
            x = matrix(batch.column("x"), d)
            if not len(x):
                continue
            small = np.abs(x.astype(float)).max(initial=0) * len(x) < 2.0 ** 62
            total[:d] += (x.sum(0).astype(object) if small else x.astype(object).sum(0))
            total[d] += len(x)
        if total[d]:
            yield _limb_rows(total.tolist())
    return run


def _product_rows(d: int, centre: list[int]):
    def run(batches):
        total, m = np.zeros((d, d), object), np.array(centre, object)
        small_centre = max(map(abs, centre), default=0) < SMALL
        some = False
        for batch in batches:
            x = matrix(batch.column("x"), d)
            some = some or len(x) > 0
            if small_centre and np.abs(x.astype(float)).max(initial=0) < SMALL:
                y = x - m.astype(np.int64)
                most = max(1, int(2 ** 52 // max(1, int(np.abs(y).max(initial=0)) ** 2)))  # products of so many rows are exact in doubles
                for i in range(0, len(y), most):
                    f = y[i:i + most].astype(float)
                    total += (f.T @ f).astype(np.int64).astype(object)
            else:
                y = x.astype(object) - m
                total += y.T @ y
        if some:
            yield _limb_rows(total.reshape(-1).tolist())
    return run


def spectral(a: np.ndarray) -> float:
    return float(np.linalg.norm(a.astype(float), 2)) if a.size else 0.0


def eigenvectors(a: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, refined from single precision."""
    d = len(a)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(d, REAL), np.eye(d, dtype=REAL)
    a = a.astype(REAL) / REAL(scale)
    one, x = np.eye(d, dtype=REAL), np.linalg.eigh(a.astype(np.float32))[1].astype(REAL)
    size, eps, least, waited = spectral(a), float(np.finfo(REAL).eps), np.inf, 0
    best = x
    for _ in range(rounds):
        r, s = one - x.T @ x, x.T @ (a @ x)
        s = (s + s.T) / 2  # rounding alone makes it differ, which small gaps would blow up
        values = np.diag(s) / (1 - np.diag(r))
        unsure = 2 * (spectral(s - np.diag(values)) + size * spectral(r)) + 4 * d * eps * size
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > unsure
        e = np.where(far, (s + r * values[None, :]) / np.where(far, gap, 1), r / 2)
        x = x + x @ e
        step = float(np.abs(e).max())
        order = np.argsort(values, kind="stable")
        cuts = np.flatnonzero(np.diff(values[order]) > unsure) + 1
        clusters = [c for c in np.split(order, cuts) if len(c) > 1]
        for c in clusters:  # a sub-solve around the cluster's mean
            own = x[:, c]
            mean = values[c].mean()
            inner = own.T @ (a @ own) - mean * (own.T @ own)
            turn = np.linalg.eigh(((inner + inner.T) / 2).astype(float))[1].astype(REAL)
            x[:, c] = own @ turn @ (REAL(1.5) * np.eye(len(c), dtype=REAL) - REAL(0.5) * (turn.T @ turn))  # orthonormal in longdouble
        if step < least:
            least, best, waited = step, x, 0
        else:
            waited += 1
        if step < 16 * eps * d and not clusters or waited >= 3:
            break
    x = best / np.sqrt((best * best).sum(0))
    values = (x * (a @ x)).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order] * REAL(scale), x[:, order]


@dataclass
class Whitening:
    """A fit: n different vectors of d entries, their sums, and for each component kept its unit vector, the root of its
    eigenvalue and its share of the variance."""
    n: int
    sums: list[int]
    axes: np.ndarray
    roots: np.ndarray
    explained: np.ndarray
    fit_list: DataFrame
    identity_error: float = 0.0

    @property
    def d(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(x - S / n) on the components, over the roots of their eigenvalues."""
        centre = [s // self.n for s in self.sums]
        rest = np.array([(s - c * self.n) / self.n for s, c in zip(self.sums, centre)])
        if np.abs(x.astype(float)).max(initial=0) < 2.0 ** 53 and max(map(abs, centre), default=0) < 2 ** 53:
            y = (x - np.array(centre, np.int64)).astype(float)
        else:
            y = (x.astype(object) - np.array(centre, object)).astype(float)
        return (y - rest) @ self.axes / self.roots

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of (n x - S)^2 of each row, exact."""
        big = max(map(abs, self.sums), default=0)
        most = int(np.abs(x.astype(float)).max(initial=0)) + 1
        if most * max(most, big) * self.d < 2 ** 62:
            squares, mixed = (x * x).sum(1).tolist(), (x * np.array(self.sums, np.int64)).sum(1).tolist()
        else:
            o = x.astype(object)
            squares, mixed = (o * o).sum(1).tolist(), (o * np.array(self.sums, object)).sum(1).tolist()
        n, own = self.n, sum(s * s for s in self.sums)
        return [n * n * a - 2 * n * b + own for a, b in zip(squares, mixed)]


def fit(vectors: DataFrame, vec_col: str = "embedding", k: int = 4) -> Whitening:
    """Fits on each different quantised vector once. Vectors of fewer entries than the longest count as filled up with 0.
    Components whose eigenvalue is 0 (up to rounding) are left out, so equal vectors alone give none."""
    rows = vectors.select(F.col(vec_col).alias("v")).filter(usable(F.col("v")))
    every = saved(rows.select(quantised(rows, "v").alias("x")).distinct())
    got = every.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    d = got["most"] or 0
    if d and got["least"] < d:  # filled up, some may be equal
        every = saved(every.select(F.slice(F.concat("x", F.array_repeat(F.lit(0).cast("long"), d)), 1, d).alias("x")).distinct())
    sums = _exact_sums(workers(every).mapInArrow(_sum_rows(d), LIMB_SCHEMA))
    if not sums or not d:
        return Whitening(sums[-1] if sums else 0, [0] * d, np.zeros((d, 0)), np.zeros(0), np.zeros(0), every)
    *sums, n = sums
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    products = _exact_sums(every.mapInArrow(_product_rows(d, centre), LIMB_SCHEMA))
    whole = [[n * products[i * d + j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    shift = max(0, max(abs(v) for row in whole for v in row).bit_length() - 62)
    a = np.array([[v >> shift for v in row] for row in whole], np.int64).astype(REAL)
    values, axes = eigenvectors(a)
    trace = sum(whole[i][i] for i in range(d))
    k = min(k, int((values > 64 * d * 2.0 ** -62 * max(values[0], 1)).sum()))
    axes, values = axes[:, :k], values[:k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)]) if k else axes
    variance = np.array([float(v) * 2.0 ** shift / n / n for v in values])
    model = Whitening(n, sums, axes.astype(float), np.sqrt(variance),
                      np.array([float(v / (REAL(trace >> shift))) for v in values]), every)
    if k:
        model.identity_error = _identity_error(model)
    return model


def _moment_rows(model):
    def run(batches):
        m = model.value
        k = len(m.roots)
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = m.project(matrix(batch.column("x"), m.d))
            w = np.column_stack([w, np.ones(len(w))])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.reshape(-1))], ["cell", "v"])
    return run


def _shipped(df: DataFrame, model: Whitening):
    slim = Whitening(model.n, model.sums, model.axes, model.roots, model.explained, None, model.identity_error)
    return df.sparkSession.sparkContext.broadcast(slim)  # d x k numbers


def _identity_error(model: Whitening) -> float:
    """The greatest difference of the whitened vectors' covariance, measured over the fit list, from the identity."""
    every, k = model.fit_list, len(model.roots)
    got = every.mapInArrow(_moment_rows(_shipped(every, model)), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1) ** 2)
    for r in got:
        total[r["cell"]] = r["v"]
    total = total.reshape(k + 1, k + 1) / model.n
    mean = total[:k, k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def _whitened_rows(model):
    def run(batches):
        m = model.value
        k = len(m.roots)
        for batch in batches:
            x = matrix(batch.column("x"), m.d)
            rows, far = len(x), m.deviations(x)
            row = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                 pa.array(np.full(rows * k, m.n), pa.int64()),
                 pa.array([v if v < 2 ** 63 else None for v in far for _ in range(k)], pa.int64()),
                 pa.array(m.project(x).reshape(-1)), pa.array(np.tile(m.explained, rows)),
                 pa.array(np.full(rows * k, m.identity_error)), pa.array([str(v) for v in far for _ in range(k)], pa.string())],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])
    return run


def whitened(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable row of ``vectors`` and component: ``id_col``, component (from 1, by falling variance), n,
    deviation (null beyond the longs; deviation_digits has it always), whitened, explained, identity_error. Rows whose
    vector is null or holds null or non-finite entries are left out; repeated rows and null ids stay; entries beyond
    the fit's length are ignored. An empty table, or a fit without components, gives an empty result; other columns
    are ignored."""
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(usable(F.col("v")))
    slim = slim.select("id", quantised(slim, "v").alias("x"))
    if model.d:
        slim = slim.withColumn("x", F.slice("x", 1, model.d))
    out = ("component int, n long, deviation long, whitened double, explained double, identity_error double, "
           "deviation_digits string")
    if not len(model.roots):
        schema = T.StructType([vectors.schema[id_col], *T._parse_datatype_string(out).fields])
        return vectors.sparkSession.createDataFrame([], schema)
    return (workers(slim).mapInArrow(_whitened_rows(_shipped(vectors, model)), f"id {ids_like(slim, 'id')}, {out}")
            .withColumnRenamed("id", id_col))
