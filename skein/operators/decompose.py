"""Truncated singular value decomposition of a table of sparse rows, in blocks.

Randomised subspace iteration.  The basis has a row for each occurring cell and is a table of blocks: ``SLICE`` cells
by one panel of columns.  A pass multiplies the rows with one panel at a time, whose bytes are bounded and which is
broadcast, and sums X'(X V) by slice; tasks are merged to the cluster's cores first, so that what is shuffled follows
the cores and the basis, not the number of input splits.  The basis is made orthonormal by a tall-skinny QR: each
slice gives its triangle, and only these small triangles reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import staged

#: Cells that numpy multiplies at once, cells of a slice, bytes of a panel in float32.
CELLS, SLICE, PANEL_BYTES = 1 << 16, 4096, 48 << 20
#: Numbers of a dense matrix for each cell in it, up to which some rows are multiplied as one.
DENSE = 32
#: Passes over the table before the last two, and columns beyond those asked for.
PASSES, OVERSAMPLE = 4, 10
BLOCK = "slice int, panel int, matrix binary"


def _batches(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and end row, row numbers, columns and values of the cells, some rows at a time."""
    idx, val = batch.column(at), batch.column(at + 1)
    size = np.diff(idx.offsets.to_numpy())
    cols, vals = idx.flatten().to_numpy(), val.flatten().to_numpy()
    end = np.append(0, np.cumsum(size))
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(end, end[i] + CELLS, "right")) - 1)
        yield i, j, np.repeat(np.arange(j - i), size[i:j]), cols[end[i] : end[j]], vals[end[i] : end[j]]
        i = j


def _added(group: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """Sums of the vectors by group; groups come in order."""
    out = np.zeros((groups, weight.shape[1]))
    if len(group):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out[group[first]] = np.add.reduceat(weight, first)
    return out


def _dense(row: np.ndarray, at: np.ndarray, val: np.ndarray, rows: int, cells: int) -> np.ndarray | None:
    """The rows as one dense matrix, if that is not much larger than their cells."""
    if rows * cells > DENSE * len(at):
        return None
    return np.bincount(row * cells + at, val, rows * cells).reshape(rows, cells)


class Layout:
    """How the occurring cells are cut into slices and the columns into panels."""

    def __init__(self, seen: np.ndarray, wide: int):
        self.seen, self.wide, self.cells = seen, wide, len(seen)
        self.slice = SLICE
        self.slices = -(-self.cells // self.slice)
        width = max(1, min(wide, PANEL_BYTES // (4 * max(1, self.cells))))
        self.panels = [(a, min(wide, a + width)) for a in range(0, wide, width)]

    def rows(self, number: int) -> int:
        return min(self.slice, self.cells - number * self.slice)

    def whole(self, table: pa.Table) -> np.ndarray:
        """A slice from the rows of all its panels."""
        number = table.column("slice")[0].as_py()
        parts = sorted(zip(table.column("panel").to_pylist(), table.column("matrix").to_pylist(), strict=True))
        return np.hstack([np.frombuffer(m).reshape(self.rows(number), -1) for _, m in parts])

    def cut(self, number: int, matrix: np.ndarray) -> pa.Table:
        parts = [np.ascontiguousarray(matrix[:, a:b]).tobytes() for a, b in self.panels]
        return pa.table([pa.array([number] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "panel", "matrix"])

    def gathered(self, basis: DataFrame, panel: int) -> np.ndarray:
        """One panel over all slices, in float32."""
        a, b = self.panels[panel]
        out = np.zeros((self.cells, b - a), np.float32)
        for r in basis.filter(F.col("panel") == panel).toLocalIterator():
            at = r.slice * self.slice
            out[at : at + self.rows(r.slice)] = np.frombuffer(r.matrix).reshape(-1, b - a)
        return out


def _by_slice(blocks: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, slices: int) -> DataFrame:
    return blocks.repartition(slices, "slice").groupBy("slice").applyInArrow(work, schema)


def _random(spark: SparkSession, layout: Layout, seed: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield from layout.cut(number, np.random.default_rng([seed, number]).standard_normal((layout.rows(number), layout.wide))).to_batches()

    return spark.range(0, layout.slices, 1, min(layout.slices, spark.sparkContext.defaultParallelism)).mapInArrow(work, BLOCK)


def _orthonormal(blocks: DataFrame, layout: Layout) -> DataFrame:
    """An orthonormal basis of the columns: QR of each slice, then of the stacked triangles."""

    def triangle(table: pa.Table) -> pa.Table:
        r = np.linalg.qr(layout.whole(table), "r")
        return pa.table([table.column("slice").slice(0, 1), pa.array([r.tobytes()], pa.binary())], names=["slice", "r"])

    found = _by_slice(blocks, triangle, "slice int, r binary", layout.slices).orderBy("slice").collect()
    parts = [np.frombuffer(x.r).reshape(-1, layout.wide) for x in found]
    ends = np.cumsum([len(x) for x in parts])[:-1]
    top = blocks.sparkSession.sparkContext.broadcast(np.split(np.linalg.qr(np.vstack(parts))[0], ends))

    def turned(table: pa.Table) -> pa.Table:
        number = table.column("slice")[0].as_py()
        return layout.cut(number, np.linalg.qr(layout.whole(table))[0] @ top.value[number])

    return staged(_by_slice(blocks, turned, BLOCK, layout.slices), "basis")


def _partial_sums(shared, panel: int, layout: Layout) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the rows of one task add to each slice of one panel."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        total = np.zeros(matrix.shape)
        for batch in batches:
            for i, j, row, col, val in _batches(batch, 0):
                at = np.searchsorted(layout.seen, col)
                x = _dense(row, at, val, j - i, layout.cells)
                if x is not None:
                    total += x.T @ (x @ matrix)
                    continue
                y = _added(row, matrix[at] * val[:, None], j - i)
                order = np.argsort(at, kind="stable")
                at, weight = at[order], y[row[order]] * val[order][:, None]
                if len(at):
                    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                    total[at[first]] += np.add.reduceat(weight, first)
        for number in range(layout.slices):
            at = number * layout.slice
            part = total[at : at + layout.rows(number)]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([panel], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "panel", "matrix"])

    return work


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m.as_py()) for m in table.column("matrix"))
    return pa.table([table.column("slice").slice(0, 1), table.column("panel").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["slice", "panel", "matrix"])


def _product(cells: DataFrame, basis: DataFrame, layout: Layout) -> DataFrame:
    """X'X times the basis."""
    spark, out = cells.sparkSession, []
    few = cells.select("idx", "val").coalesce(spark.sparkContext.defaultParallelism)
    for panel in range(len(layout.panels)):
        shared = spark.sparkContext.broadcast(layout.gathered(basis, panel))
        parts = few.mapInArrow(_partial_sums(shared, panel, layout), BLOCK)
        out.append(staged(_by_slice(parts, _summed, BLOCK, layout.slices), "product"))
        shared.unpersist()
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _rotation(basis: DataFrame, product: DataFrame, layout: Layout, k: int) -> np.ndarray:
    """Columns that turn the basis to the leading k directions, each with its largest entry above 0."""

    def inner(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table([left.column("slice").slice(0, 1), pa.array([(layout.whole(left).T @ layout.whole(right)).tobytes()], pa.binary())], names=["slice", "m"])

    pairs = basis.repartition(layout.slices, "slice").groupBy("slice").cogroup(product.repartition(layout.slices, "slice").groupBy("slice"))
    total = sum(np.frombuffer(r.m).reshape(layout.wide, -1) for r in pairs.applyInArrow(inner, "slice int, m binary").toLocalIterator())
    value, vector = np.linalg.eigh((total + total.T) / 2)
    turn = vector[:, np.argsort(-value)[:k]]

    def peaks(table: pa.Table) -> pa.Table:
        m = layout.whole(table) @ turn
        return pa.table([table.column("slice").slice(0, 1), pa.array([m[np.abs(m).argmax(0), np.arange(k)].tobytes()], pa.binary())], names=["slice", "m"])

    top = np.vstack([np.frombuffer(r.m) for r in _by_slice(basis, peaks, "slice int, m binary", layout.slices).orderBy("slice").collect()])
    return turn * np.where(top[np.abs(top).argmax(0), np.arange(k)] < 0, -1.0, 1.0)


def _projected(cells: DataFrame, keys: list[str], basis: DataFrame, turn: np.ndarray, layout: Layout) -> DataFrame:
    """Keys with ``embedding``: each row times the turned basis, panel by panel."""
    k = turn.shape[1]
    final = Layout(layout.seen, k)
    rotated = staged(_by_slice(basis, lambda t: final.cut(t.column("slice")[0].as_py(), layout.whole(t) @ turn), BLOCK, layout.slices), "components")
    shared = [cells.sparkSession.sparkContext.broadcast(final.gathered(rotated, p)) for p in range(len(final.panels))]
    schema = T.StructType([*cells.select(*keys).schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, col, val in _batches(batch, len(keys)):
                at = np.searchsorted(final.seen, col)
                x = _dense(row, at, val, j - i, final.cells)
                flat = np.hstack([_added(row, s.value[at] * val[:, None], j - i) if x is None else x @ s.value for s in shared]).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * k), pa.array(flat.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[: len(keys)]], lists], names=schema.names)

    return cells.select(*keys, "idx", "val").mapInArrow(work, schema)


def _variance(cells: DataFrame, rows: int) -> DataFrame:
    """One row: the variance of all columns together."""
    each = cells.withColumn("r", F.monotonically_increasing_id()).select("r", F.explode(F.arrays_zip("idx", "val")).alias("c")).groupBy("r", "c.idx").agg(F.sum("c.val").alias("x"))
    by_cell = each.groupBy("idx").agg((F.sum(F.col("x") * F.col("x")) / rows - F.pow(F.sum("x") / rows, 2)).alias("v"))
    return by_cell.agg(F.sum("v").alias("total_variance"))


def truncated_svd(cells: DataFrame, keys: list[str], k: int = 128, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(keys + embedding, one row of variance figures) of rows of ``idx`` and ``val`` cells; a cell may repeat in a row.

    k is cut to one less than the occurring cells and than the rows.  The numbers of the occurring cells, at most the
    hashed width, are held by the driver.  A table without cells has embeddings of one 0.
    """
    spark = cells.sparkSession
    cells = staged(cells, "cells")
    seen = np.array([r.c for r in cells.select(F.explode("idx").alias("c")).distinct().orderBy("c").toLocalIterator()], np.int64)
    rows = cells.count()
    if not len(seen):
        out = cells.select(*keys, F.array(F.lit(0.0).cast("float")).alias("embedding"))
        return out, spark.range(1).selectExpr("0.0D AS kept_variance", "0.0D AS total_variance", "CAST(NULL AS DOUBLE) AS explained_ratio")
    k = max(1, min(k, len(seen) - 1, rows - 1))
    layout = Layout(seen, min(len(seen), k + OVERSAMPLE))
    basis = _orthonormal(_random(spark, layout, seed), layout)
    for _ in range(PASSES):
        basis = _orthonormal(_product(cells, basis, layout), layout)
    turn = _rotation(basis, _product(cells, basis, layout), layout, k)
    out = _projected(cells, keys, basis, turn, layout)
    kept = out.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).agg(F.sum("v").alias("kept_variance"))
    figures = kept.join(F.broadcast(_variance(cells, rows)))
    return out, figures.withColumn("explained_ratio", F.col("kept_variance") / F.col("total_variance"))
