"""The decomposition in slices and panels against numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import decompose


def sparse(spark, x, tasks=4):
    rows = [(i, [int(c) * 7 for c in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "k long, idx array<int>, val array<double>").repartition(tasks)


def close(x, z, k):
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.linalg.norm(z, axis=0), s[:k], rtol=1e-4, atol=1e-3)
    # the rows' places are the same up to the sign of each component
    assert np.allclose(z @ z.T, (u[:, :k] * s[:k] ** 2) @ u[:, :k].T, atol=2e-3 * s[0] ** 2)


@pytest.mark.parametrize("slices,panels", [(1, 1), (5, 3)])
def test_svd_in_blocks(spark, monkeypatch, slices, panels):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((150, 20)) * 0.6 ** np.arange(20) @ ((rng.random((20, 40)) < 0.3) * rng.integers(1, 9, (20, 40)))
    monkeypatch.setattr(decompose, "SLICE", -(-40 // slices))
    monkeypatch.setattr(decompose, "PANEL_BYTES", 4 * 40 * -(-18 // panels))
    layout = decompose.Layout(np.arange(40), 18)
    assert (layout.slices, len(layout.panels)) == (slices, panels)
    out, figures = decompose.truncated_svd(sparse(spark, x), ["k"], 8)
    z = np.array([r.embedding for r in out.orderBy("k").collect()])
    close(x, z, 8)
    f = figures.first()
    assert abs(f.explained_ratio - z.var(0).sum() / x.var(0).sum()) < 1e-5 and f.kept_variance < f.total_variance


def test_rows_as_dense_matrices_give_the_same(spark, monkeypatch):
    """Few occurring cells are multiplied as dense rows, many as single cells; the sums are the same."""
    rng = np.random.default_rng(4)
    cells = sparse(spark, rng.integers(0, 3, (300, 25)) * (rng.random((300, 25)) < 0.7), 1)
    layout = decompose.Layout(np.arange(25) * 7, 6)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in cells.select("idx", "val").collect()])

    class Shared:
        value = rng.standard_normal((25, 6)).astype(np.float32)

    taken = []
    dense = decompose._dense
    monkeypatch.setattr(decompose, "_dense", lambda *a: taken.append(dense(*a)) or taken[-1])
    got = []
    for most in (32, 0):
        monkeypatch.setattr(decompose, "DENSE", most)
        got.append([np.frombuffer(m.as_py()) for b in decompose._partial_sums(Shared, 0, layout)(iter([batch])) for m in b.column(2)])
    assert [x is not None for x in taken] == [True, False] and np.allclose(got[0], got[1])


def test_svd_reconstructs(spark, monkeypatch):
    """Rows of rank 5 are kept whole by 5 components, whatever the slices."""
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (90, 5)) @ rng.integers(-2, 3, (5, 30)).astype(float)
    monkeypatch.setattr(decompose, "SLICE", 7)
    z = np.array([r.embedding for r in decompose.truncated_svd(sparse(spark, x), ["k"], 5)[0].orderBy("k").collect()])
    assert np.allclose((z**2).sum(1), (x**2).sum(1), rtol=1e-5)


def test_shuffle_follows_the_cores_not_the_tasks(spark):
    """Partial sums come from as many tasks as there are cores, though the table has far more splits."""
    rng = np.random.default_rng(3)
    cells = sparse(spark, rng.integers(0, 3, (200, 12)).astype(float), 60)
    layout = decompose.Layout(np.arange(12) * 7, 6)
    basis = decompose._orthonormal(decompose._random(spark, layout, 1), layout)
    shared = spark.sparkContext.broadcast(layout.gathered(basis, 0))
    parts = cells.select("idx", "val").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(decompose._partial_sums(shared, 0, layout), decompose.BLOCK)
    assert parts.count() <= spark.sparkContext.defaultParallelism < 60
    v = np.hstack([layout.gathered(basis, p) for p in range(len(layout.panels))])
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-6)


def test_svd_of_small_tables(spark):
    none = spark.createDataFrame([], "k long, idx array<int>, val array<double>")
    assert decompose.truncated_svd(none, ["k"])[0].count() == 0 and decompose.truncated_svd(none, ["k"])[1].first().explained_ratio is None
    blank = spark.createDataFrame([(1, [], []), (2, [], [])], none.schema)
    assert [r.embedding for r in decompose.truncated_svd(blank, ["k"])[0].collect()] == [[0.0], [0.0]]
    one = spark.createDataFrame([(1, [5], [2.0])], none.schema)
    assert [abs(r.embedding[0]) for r in decompose.truncated_svd(one, ["k"])[0].collect()] == [2.0]
    twice = spark.createDataFrame([(1, [5, 5, 9], [1.0, 1.0, 0.0]), (2, [9], [1.0])], none.schema).withColumn("note", F.lit("x"))
    assert round(abs(decompose.truncated_svd(twice, ["k"])[0].filter("k = 1").first().embedding[0]), 4) == 2.0
