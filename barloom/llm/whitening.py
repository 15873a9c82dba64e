"""Operator 13: whitening of embeddings on refined eigenvectors of their covariance.

1. Sums. One pass over the distinct vectors adds their entries as whole numbers, so n and the sums S are exact.
2. Covariance. A second pass centres each vector on S / n and multiplies: a task adds the matrices of
   its batches and returns one, and the entries of all are summed.
3. Eigenvectors, from the d x d covariance in one task: those of LAPACK in float32 are the start.
   Each iteration of Ogita and Aishima forms R = I - X'X and S = X'VX by matrix products in extended
   precision, estimates the eigenvalues s_ii / (1 - r_ii), and corrects X by X E with
   e_ij = (s_ij + lambda_j r_ij) / (lambda_j - lambda_i). Where eigenvalues lie closer than the
   residual can tell apart, e_ij = r_ij / 2, and each such cluster gets a sub-solve: the small
   matrix of V less the cluster's mean, in the cluster's basis, is decomposed by itself, which
   rotates the basis. It ends when the residual vanishes or after ITERATIONS, keeps the best and raises if that is not small.
4. Whitening. Each row is centred, projected on the leading components and divided by the root of
   the eigenvalue; the covariance of the result over the fitted vectors is compared with the identity.

What one task holds is bounded by the dimension (d x d numbers), what is broadcast by d x 5 numbers for each
dimension that occurs; neither grows with the rows. The signs of the components are those with a
positive largest entry.

Edge cases: vectors that are null or hold null or non-finite entries are dropped; repeated vectors
are fitted once and each row of them is returned; vectors of each dimension are fitted apart (a
vector without entries has no components and no row); components with an eigenvalue of zero (to
rounding: one vector, or fewer directions than components) have a null whitened value and don't count
in identity_error, which is null if none is left; explained is null if all are zero; entries beyond
64 bits take the nearest long; a deviation beyond 64 bits is null; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, COMPONENTS = 256, 4
#: Most refinements; three are usual, and each sub-solve of a cluster takes one or two more.
ITERATIONS = 30
#: Eigenvalues closer than so many times the residual form a cluster; corrections stay below 1 / MARGIN.
MARGIN = 50
#: Residual, relative to the matrix, that the last refinement must reach.
SETTLED = 1e-15
#: Eigenvalues below this share of the trace count as zero.
ZERO = 1e-13
#: Whole numbers below this stay clear of 64 bits.
ROOM = (1 << 62) - 1


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x (array of longs) of the usable vectors."""
    usable = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & usable)
    return rows.select("vec_id", F.transform("v", lambda e: F.floor(e * scale).cast("long")).alias("x"))


def by_dimension(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, pd.DataFrame]]:
    """Dimension, matrix and rows of each part of a batch whose vectors have one dimension."""
    for pdf in batches:
        for d, part in pdf.groupby(pdf["x"].map(len), sort=True):
            yield int(d), np.stack(part["x"].to_numpy()).astype(np.int64), part


def exact_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """d, n and pos, s: the number of vectors and the exact sum of each entry, for each dimension met."""
    count: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for d, x, _ in by_dimension(batches):
        safe = int(max(abs(int(x.max())), abs(int(x.min())))) * len(x) < ROOM
        sums = (x if safe else x.astype(object)).sum(axis=0).astype(object)
        count[d], total[d] = count.get(d, 0) + len(x), total.get(d, 0) + sums
    for d, s in total.items():
        yield pd.DataFrame({"d": d, "n": count[d], "pos": np.arange(d), "s": [Decimal(int(v)) for v in s]})


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once where n x - S fits 64 bits."""
    most = max((abs(int(v)) for v in s), default=0)
    if n * max(abs(int(x.max())), abs(int(x.min()))) + most < ROOM:
        return (n * x - s.astype(np.int64)).astype(np.float64) / n
    return (n * x.astype(object) - s).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; None beyond 64 bits."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max((abs(int(v)) for v in s), default=0)
    if most**2 * x.shape[1] < ROOM:
        return ((n * x - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
    wide = ((n * x.astype(object) - s) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in wide]


def clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of ascending values whose neighbours lie no farther apart than `apart`, two at least."""
    parts = np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > apart) + 1)
    return [p for p in parts if len(p) > 1]


def refined(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in double precision."""
    size = float(np.abs(a).max())
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    wide = (a / size).astype(np.longdouble)
    _, start = np.linalg.eigh((a / size).astype(np.float32))
    x, one = start.astype(np.longdouble), np.eye(len(a), dtype=np.longdouble)
    best, best_x = np.inf, x
    for _ in range(ITERATIONS):
        r, s = one - x.T @ x, x.T @ wide @ x
        s = (s + s.T) / 2  # else rounding over small gaps turns vectors apart
        value = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(value, kind="stable")
        x, r, s, value = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], value[order]
        off = s - np.diag(value)
        residual = float(max(np.abs(off).max(), np.abs(r).max()))
        if residual < best:
            best, best_x = residual, x
        if residual < 1e-18:
            break
        apart = MARGIN * (np.linalg.norm(off.astype(np.float64), 2) + np.linalg.norm(value.astype(np.float64), np.inf) * np.linalg.norm(r.astype(np.float64), 2))
        gap = value[None, :] - value[:, None]
        clear = np.abs(gap) > apart
        e = np.where(clear, (s + value[None, :] * r) / np.where(clear, gap, 1), r / 2)
        x = x + x @ e
        for p in clusters(value, apart):
            basis, middle = x[:, p], value[p].mean()
            small = basis.T @ (wide @ basis - middle * basis)
            scale = np.abs(small).max()
            if scale:
                _, turn = np.linalg.eigh(((small + small.T) / (2 * scale)).astype(np.float64))
                x[:, p] = basis @ turn.astype(np.longdouble)
    if best > SETTLED * len(a):
        raise ArithmeticError(f"eigenvectors did not settle: residual {best:.1e}")
    x = best_x[:, ::-1]
    x = x / np.sqrt((x**2).sum(axis=0))
    value = ((x * (wide @ x)).sum(axis=0) * size).astype(np.float64)
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)
    return value, x.astype(np.float64)


@dataclass
class Fit:
    """What one dimension's vectors are whitened by."""

    n: int
    s: np.ndarray
    value: np.ndarray | None = None
    explained: list[float | None] | None = None
    vector: np.ndarray | None = None


def fit(x: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each dimension that occurs; x: distinct vectors. What reaches the driver is components + 1 vectors a dimension."""
    sums = x.mapInPandas(exact_sums, "d int, n long, pos int, s decimal(38,0)")
    per_pos = sums.groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("d", "pos").toPandas()
    fits = {int(d): Fit(int(part["n"].iloc[0]), np.array([int(v) for v in part["s"]], object)) for d, part in per_pos.groupby("d")}
    shared = x.sparkSession.sparkContext.broadcast(fits)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for d, m, _ in by_dimension(batches):
            y = centred(m, shared.value[d].n, shared.value[d].s)
            total[d] = total.get(d, 0) + y.T @ y
        for d, t in total.items():
            i, j = np.triu_indices(d)
            yield pd.DataFrame({"d": d, "i": i, "j": j, "v": t[i, j]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        a = np.zeros((d, d))
        a[pdf["i"], pdf["j"]] = pdf["v"] / shared.value[d].n
        a = np.triu(a) + np.triu(a, 1).T
        trace, k = float(np.trace(a)), min(components, d)
        value, vector = refined(a)
        value = np.where(value > ZERO * trace, value, 0.0)[:k]
        return pd.DataFrame({"d": d, "component": np.arange(k), "value": value, "explained": value / trace if trace else None, "vector": vector.T[:k].tolist()})

    parts = x.mapInPandas(products, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    solved = parts.groupBy("d").applyInPandas(solve, "d int, component int, value double, explained double, vector array<double>")
    for d, part in solved.orderBy("d", "component").toPandas().groupby("d"):
        some = fits[int(d)]
        some.value, some.vector = part["value"].to_numpy(np.float64), np.stack(part["vector"].to_numpy())
        some.explained = [None if e is None or e != e else float(e) for e in part["explained"]]
    return fits


def projected(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """rows with d and __w: n, deviation, whitened (array), explained (array)."""
    shared = rows.sparkSession.sparkContext.broadcast(fits)

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            out: list[tuple | None] = [None] * len(series)
            for d, x, part in by_dimension(iter([pd.DataFrame({"x": series, "at": np.arange(len(series))})])):
                some = shared.value[d]
                z = centred(x, some.n, some.s) @ some.vector.T
                z = np.divide(z, np.sqrt(some.value), out=np.full_like(z, np.nan), where=some.value > 0)
                for at, deviation, row in zip(part["at"], deviations(x, some.n, some.s), z.tolist(), strict=True):
                    out[at] = (some.n, deviation, [None if e != e else e for e in row], some.explained)
            done = pd.DataFrame(out, columns=["n", "deviation", "whitened", "explained"])
            yield done.assign(deviation=pd.array(done["deviation"].tolist(), "Int64"))

    shape = "struct<n:long,deviation:long,whitened:array<double>,explained:array<double>>"
    return rows.withColumns({"d": F.size("x"), "__w": F.pandas_udf(work, shape)("x")})


def identity_errors(white: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """d, identity_error: how far the covariance of the whitened vectors is from the identity."""
    at = lambda i: F.try_element_at("__w.whitened", F.lit(i + 1))
    errors = [F.abs(F.covar_pop(at(i), at(j)) - F.lit(float(i == j))) for i in range(components) for j in range(i, components)]
    return white.groupBy("d").agg(F.array_max(F.array(*errors)).alias("identity_error"))


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    common.small_batches(vectors.sparkSession)
    rows = common.write_shared(scaled(vectors, scale), "scaled")
    distinct = common.write_shared(rows.select("x").distinct(), "distinct")
    fits = fit(distinct, components)
    errors = {r["d"]: r["identity_error"] for r in identity_errors(projected(distinct, fits), components).collect()}
    error = F.lit(None).cast("double")
    for d, e in errors.items():
        error = F.when(F.col("d") == d, F.lit(e)).otherwise(error)
    each = projected(rows, fits).select("vec_id", "__w.n", "__w.deviation", error.alias("identity_error"), F.posexplode(F.arrays_zip(F.col("__w.whitened").alias("whitened"), F.col("__w.explained").alias("explained"))).alias("pos", "c"))
    return each.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every usable vector."""
    return whitened(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
