"""Whitening of embeddings: a distributed covariance, its eigenvectors in float32, refined by matrix products in higher precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, materialize

#: Entries at least this large don't fit the integers; their rows are dropped like those with non-finite entries.
TOO_LARGE = 2.0**40


def fit_list(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """Rows that take part, as vec_id and integers x = floor(1024 c) + 100000, written; and their number of dimensions.

    Rows go whose vector is null or empty or holds null, non-finite or (see ``TOO_LARGE``) huge entries, or has another
    length than most vectors have (of equally frequent lengths, the greater counts).
    """
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * 1024) + 100_000).alias("x"))
    rows = materialize(rows, "integers")
    most = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = most["dim"] if most else 0
    return rows.where(F.size("x") == dim), dim


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def totals(rows: DataFrame, column: str, dim: int) -> tuple[int, np.ndarray]:
    """Number of rows and sums by dimension, exact for integers."""

    def add(batches):
        n, total = 0, 0
        for batch in batches:
            x = matrix_of(batch.column(0), dim)
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(total), pa.array(np.full(dim, n))], names=["at", "total", "n"])

    kind = rows.schema[column].dataType.elementType.simpleString()
    parts = rows.select(column).mapInArrow(alone(add), f"at int, total {kind}, n long")
    found = sorted(parts.groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())  # a row for each dimension
    return (found[0]["n"], np.array([r["total"] for r in found])) if found else (0, np.zeros(dim))


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - total / n in double precision; for integers the whole part is taken off exactly first."""
    if x.dtype.kind == "f":
        return x - total / n
    whole, rest = np.divmod(total, n)
    return (x - whole).astype(np.float64) - rest / n


def _add_rows(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part", kind="stable")
    total = np.sum(np.frombuffer(b"".join(group["row"])).reshape(len(group), -1), axis=0)
    return pd.DataFrame({"at": [group["at"].iloc[0]], "part": [group["part"].iloc[0] % 256], "row": [total.tobytes()]})


def covariance(rows: DataFrame, column: str, n: int, total: np.ndarray) -> np.ndarray:
    """Covariance with divisor n, centred before multiplying. A task sums up its products; their rows are added up in two
    levels, so that no group holds one for each of very many tasks. The driver holds one matrix of dim x dim."""
    dim = len(total)

    def multiply(batches):
        out = np.zeros((dim, dim))
        for batch in batches:
            d = centred(matrix_of(batch.column(0), dim), n, total)
            out += d.T @ d
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(np.zeros(dim, np.int64)), pa.array([r.tobytes() for r in out], pa.binary())], names=["at", "part", "row"])

    shape = "at int, part long, row binary"
    parts = materialize(rows.select(column).mapInArrow(alone(multiply), shape).withColumn("part", F.spark_partition_id().cast("long")), "products")
    first = parts.withColumn("branch", F.col("part") % 256).groupBy("at", "branch").applyInPandas(_add_rows, shape)
    found = sorted(first.groupBy("at").applyInPandas(_add_rows, shape).collect())
    return np.array([np.frombuffer(r["row"]) for r in found]).reshape(dim, dim) / n


def _clusters(values: np.ndarray, delta: float) -> list[np.ndarray]:
    """Runs of eigenvalues that stand no further apart than ``delta``, of two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > delta) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def _norm(m: np.ndarray) -> float:
    return float(np.linalg.norm(m.astype(np.float64), 2))


def refine(a: np.ndarray, x: np.ndarray, precision, rounds: int, enough: float) -> tuple[np.ndarray, np.ndarray]:
    """Ogita and Aishima's iteration for a symmetric ``a`` and approximate eigenvectors ``x``, all in ``precision``.

    With R = I - X'X and S = X'AX, eigenvalues are s_ii / (1 - r_ii), and X goes to X + XE. For eigenvalues further apart
    than delta, e_ij = (s_ij + l_j r_ij) / (l_j - l_i), which converges quadratically; for closer ones e_ij = r_ij / 2
    only makes the vectors orthogonal. The vectors of a cluster of close ones are then turned by a problem of their own:
    the eigenvectors of X_k' (A - m) X_k with the cluster's mean m, whose entries are as small as the cluster is wide, so
    that solving it in double precision tells apart what the whole matrix can't.
    """
    a, x = a.astype(precision), x.astype(precision)
    one, size = np.eye(len(a), dtype=precision), _norm(a)
    values = np.zeros(len(a), precision)
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # else rounding, divided by a small gap, spoils e_ij + e_ji = r_ij
        values = np.diag(s) / (1 - np.diag(r))
        delta = 2 * (_norm(s - np.diag(values)) + size * _norm(r))
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= delta
        e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        change = float(np.abs(e).max())
        for j in _clusters(values, delta):
            own = x[:, j]
            t = own.T @ (a @ own) - values[j].mean() * (own.T @ own)
            width = np.abs(t).max()
            if width > 0:
                turned = np.linalg.eigh(((t + t.T) / (2 * width)).astype(np.float64))[1]
                off = t - np.diag(np.diag(t))
                change = max(change, float(np.abs(off).max() / width) if np.abs(off).max() > enough * size else 0.0)
                x[:, j] = own @ turned.astype(precision)
        if change <= enough:
            break
    return values, x


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix by falling value and unit eigenvectors as columns: float32 first, refined in double precision, then in extended precision."""
    scale = np.abs(v).max() or 1.0
    a = (v + v.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1]
    _, x = refine(a, x, np.float64, 12, 1e-9)
    values, x = refine(a, x, np.longdouble, 6, 1e-17)
    values, x = values.astype(np.float64), (x / np.sqrt((x * x).sum(axis=0))).astype(np.float64)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _whiten(n: int, total: np.ndarray, vectors: np.ndarray, values: np.ndarray):
    dim = len(total)
    scale = np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1)), 0.0)

    def whiten(batches):
        for batch in batches:
            x = matrix_of(batch.column(1), dim)
            d = n * x - total
            if len(x) and float(np.abs(d).max()) ** 2 * dim >= 2.0**62:  # sums that may not fit: whole numbers of any size
                deviation = [s if (s := sum(e * e for e in row)) < 2**63 else None for row in d.tolist()]
            else:
                deviation = (d * d).sum(axis=1)
            w = centred(x, n, total) @ vectors * scale
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(values), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), out], names=["vec_id", "deviation", "w"])

    return whiten


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Project vectors on the first principal components with unit variance: a row for each vector and component.

    All vectors that take part (see :func:`fit_list`) are fitted. Sums are exact integers; the covariance is centred
    before multiplying; tasks send a matrix each, never rows, and the driver holds matrices of dim x dim only. Columns:
    vec_id, component (from 1, by falling eigenvalue), n, deviation (exact; null beyond 64 bits), whitened, explained,
    and identity_error, the largest entry of the whitened rows' covariance less the identity, measured on the rows.

    With fewer dimensions than ``components`` there are as many components. An eigenvalue that is zero up to rounding
    (equal rows, fewer rows than components) counts as zero: whitened and explained are 0, and its component stays out
    of identity_error. Vectors with equal or null ids are vectors of their own. Other columns are ignored. A table
    without rows that take part gives an empty result.
    """
    spark = vectors.sparkSession
    rows, dim = fit_list(vectors, id_col=id_col, vector_col=vector_col)
    if not dim:
        return spark.createDataFrame([], OUT)
    n, total = totals(rows, "x", dim)
    v = covariance(rows, "x", n, total)
    values, x = eigenvectors(v)
    trace = float(np.trace(v))
    values = np.where(values > trace * dim * 1e-15, values, 0.0)[:components]
    wide = materialize(rows.mapInArrow(alone(_whiten(n, total, x[:, :components], values)), "vec_id long, deviation long, w array<double>"), "whitened")
    kept = int((values > 0).sum())
    error = 0.0
    if kept:
        own = wide.select(F.slice("w", 1, kept).alias("w"))
        error = float(np.abs(covariance(own, "w", *totals(own, "w", kept)) - np.eye(kept)).max())
    explained = F.array(*[F.lit(float(e / trace) if trace else 0.0) for e in values])
    long = wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
