"""Whitening of embeddings: the covariance's upper triangle as SQL aggregates, its eigenvectors by LAPACK.

Two passes fit: one counts the vectors and sums each dimension; the next sums the centred products of every pair of
dimensions, all of them in one aggregation whose expressions are generated. What reaches the driver is a row of
d (d + 1) / 2 numbers, whatever the number of vectors. A third pass measures the whitened rows' covariance by the same
aggregation; the rows themselves are projected in batches, without a shuffle.

Entries become longs (floor(64 c) + 1000000), so that counts, sums and deviations are exact.

Nulls and edges: vectors that are null or empty, that hold a null or non-finite entry or one of 2^40 or more (no exact
long), or whose length is not the commonest (of ties, the shorter) are left out; a null id is carried along; rows that repeat are
each a row of the fit and of the result; components without variance (fewer vectors than dimensions, equal vectors) are
zero in every row and count for no error; a deviation beyond a long is null; an empty table gives an empty one;
other columns are not read, whatever their names. Vectors of some hundred dimensions are what one aggregation holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Entries from here on have no exact long once scaled, summed and squared.
_MOST = float(1 << 40)
_LONG = float(1 << 63) * (1 - 1e-9)
RESULT = "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, x array<long>) of the vectors that are whole, and their dimension (0 where there are none)."""
    v = vectors.select(named(id_col).alias("vec_id"), named(vector_col).cast("array<double>").alias("v"))
    v = v.filter("v is not null and size(v) > 0").filter(F.forall("v", lambda c: F.coalesce(F.abs(c) < _MOST, F.lit(False))))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = sizes["d"] if sizes else 0
    return v.filter(F.size("v") == d).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x")), d


def sums(x: DataFrame, column: str, d: int) -> tuple[int, np.ndarray]:
    """Number of rows and the exact sum of each dimension of an array of longs."""
    row = x.agg(F.count("*"), *[F.sum(F.get(column, F.lit(i))) for i in range(d)]).first()
    return row[0], np.array([s or 0 for s in row[1:]], dtype=np.int64)


def covariance(x: DataFrame, column: str, centre: np.ndarray, n: int) -> np.ndarray:
    """Covariance of an array column about ``centre``: a generated expression for each pair of dimensions, one aggregation."""
    d = len(centre)
    # no entry is null; that Spark knows it halves the code of two thousand sums
    centred = x.select(*[F.coalesce(F.get(column, F.lit(i)).cast("double") - F.lit(float(centre[i])), F.lit(0.0)).alias(f"y{i}") for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = centred.agg(*[F.expr(f"sum(y{i} * y{j})") for i, j in pairs]).first()
    v = np.zeros((d, d))
    for (i, j), s in zip(pairs, row, strict=True):
        v[i, j] = v[j, i] = s / n
    return v


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; of either sign the one whose largest entry is positive."""
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    top = q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])]
    return e, q * np.where(top < 0, -1.0, 1.0)


def _projected(n: int, total: np.ndarray, matrix: np.ndarray):
    """Rows (vec_id, deviation, w) of batches of (vec_id, x)."""
    d, m = matrix.shape

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            lists = b.column(1)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), d)
            apart = n * x - total
            size = np.square(apart.astype(float)).sum(axis=1)
            deviation = pa.array(np.where(size < _LONG, np.square(apart).sum(axis=1), 0), pa.int64(), mask=size >= _LONG)
            w = (apart / n) @ matrix
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * m)
            yield pa.RecordBatch.from_arrays([b.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["vec_id", "deviation", "w"])

    return project


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Each whole vector's components, decorrelated and of unit variance, one row for each of the first ``most``."""
    kind = dict(vectors.dtypes)[id_col]
    x, d = usable(vectors, id_col, vector_col)
    if not d:
        return vectors.sparkSession.createDataFrame([], RESULT.format(kind=kind))
    n, total = sums(x, "x", d)
    v = covariance(x, "x", total / n, n)
    e, q = components(v, most)
    real = e > max(e[0], 0.0) * d * np.finfo(float).eps
    matrix = np.where(real, q / np.sqrt(np.where(real, e, 1.0)), 0.0)
    rows = x.mapInArrow(_projected(n, total, matrix), f"vec_id {kind}, deviation long, w array<double>")
    identity = covariance(rows, "w", np.zeros(len(e)), n)
    error = float(np.abs((identity - np.eye(len(e)))[real][:, real]).max(initial=0.0))
    shares = F.array(*[F.lit(float(s)) for s in (np.where(real, e, 0.0) / np.trace(v) if np.trace(v) > 0 else np.zeros(len(e)))])
    out = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op13(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
