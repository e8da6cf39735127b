"""Whitening against numpy, on vectors that are left out, ties, and tables without variance."""

from __future__ import annotations

import numpy as np
import pytest

from strandlog.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def plain(vectors: list[list[float]], most: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    y = np.array(x - s / n, float)
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return deviation, e, y @ (q / np.sqrt(e)), e / np.trace(y.T @ y / n)


def made(n: int, d: int, seed: int = 3) -> list[list[float]]:
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ (r.normal(size=(d, d)) / 3)).astype(np.float32).tolist()


def test_against_numpy(spark):
    v = made(400, 12)
    v += [v[0]] * 30
    bad = [None, [], [float("nan")] + v[0][1:], [float("inf")] + v[0][1:], [None] + v[0][1:], v[0][:5]]
    rows = [(i, x, 0, 9, "c") for i, x in enumerate(v + bad)]
    out = whitening.op13(spark.createDataFrame(rows, SCHEMA).repartition(3)).toPandas()
    deviation, e, w, share = plain(v)
    assert len(out) == len(v) * 12 and set(out.vec_id) == set(range(len(v))) and (out.n == len(v)).all()
    out = out.sort_values(["vec_id", "component"])
    got = out.whitened.to_numpy().reshape(len(v), 12)
    assert (out.deviation.to_numpy().reshape(len(v), 12) == deviation[:, None]).all()
    assert np.allclose(out.explained.to_numpy().reshape(len(v), 12), share, rtol=1e-9)
    sign = np.sign((got * w).sum(axis=0))
    assert np.allclose(got * sign, w, atol=1e-7)
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-9


def test_at_most_thirty_two_components(spark):
    rows = [(i, x, 0, 9, "c") for i, x in enumerate(made(90, 40))]
    out = whitening.op13(spark.createDataFrame(rows, SCHEMA))
    assert out.agg({"component": "max"}).first()[0] == 32 and out.count() == 90 * 32


@pytest.mark.parametrize("rows", [[[1.0, 2.0]], [[1.0, 2.0]] * 5, [[1.0, 0.0], [3.0, 0.0], [5.0, 0.0]]])
def test_components_without_variance_are_zero(spark, rows):
    out = whitening.op13(spark.createDataFrame([(i, x, 0, 9, "c") for i, x in enumerate(rows)], SCHEMA)).toPandas()
    flat = out[out.explained == 0]
    assert len(out) == 2 * len(rows) and (flat.whitened == 0).all() and (out.identity_error < 1e-9).all() and len(flat)


def test_empty_tables_and_null_ids(spark):
    some = spark.createDataFrame([(None, [1.0, 2.0], 0, 9, "c"), (None, [2.0, 2.5], 0, 9, "c"), (1, None, 0, 9, "c")], SCHEMA)
    assert whitening.op13(some).filter("vec_id is null").count() == 4 == whitening.op13(some).count()
    for empty in (some.limit(0), some.filter("embedding is null")):
        out = whitening.op13(empty)
        assert out.count() == 0 and out.columns == whitening.op13(some).columns


def test_one_aggregation_for_all_pairs(spark):
    """The covariance is one aggregate over generated expressions: a single shuffle of one row from each task."""
    x, d = whitening.usable(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0, 9, "c")], SCHEMA), "vec_id", "embedding")
    assert d == 3
    v = whitening.covariance(spark.createDataFrame([([1, 2],), ([3, 8],)], "x array<long>"), "x", np.array([2.0, 5.0]), 2)
    assert v.tolist() == [[1.0, 3.0], [3.0, 9.0]]
