"""Hard negatives by exact integer scores from float32 matrix products.

Vectors are quantised to integers.  Each block of scores is computed modulo several primes just below 1024:
residues around 0 are multiplied as float32 matrices, 64 components at a time, so that every partial sum stays
below 2**24 and is exact; Garner's form of Chinese remaindering with digits around 0 gives the signed score.  There
are as many primes as the largest possible score of the table needs.

Anchors are a stated query set against all rows: rows are dealt to tiles and anchors to blocks of bounded size,
and each (tile, block) keeps only the best rows of each anchor.  A first round finds each anchor's positives, a
second the negatives in the window below each positive's score.

Rows with a null label or vector, or a null or non-finite component, take no part.  Vectors of different lengths
are compared as if zeros followed the shorter.  Repeated rows are rows of their own: an anchor's copy is one of its
other rows, and a repeated anchor gives its rows as often.  Equal scores are ordered by id, a null id last; a null
id is no anchor.  An empty table, or one without anchors, gives no rows; other columns are ignored.  Scores
that could exceed 64 bits raise an error before any is computed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import small_batches, staged

#: Bytes of components (32 bits each) in a tile of rows and in a block of anchors, and scores computed at once.
TILE_BYTES, BLOCK_BYTES, SCORES = 8 << 20, 1 << 20, 1 << 20
#: Components multiplied at once; with primes below 1024, 64 * 511**2 is below 2**24.
DEPTH, BELOW = 64, 1024
NO_ID = (1 << 63) - 1


def moduli(bound: int) -> list[int]:
    """Primes below 1024, the largest first, whose product exceeds all differences of scores up to ``bound``."""
    out, product, p = [], 1, BELOW
    while product <= 2 * bound + 1:
        p -= 1
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
    return out


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Integers in float64 to their residues around 0."""
    return x - p * np.rint(x / p)


class Residues:
    """A matrix of integers as one float32 matrix for each prime."""

    def __init__(self, matrix: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [_centred((matrix % p).astype(np.float64), p).astype(np.float32) for p in primes]

    def some(self, rows: np.ndarray | slice) -> Residues:
        out = object.__new__(Residues)
        out.primes, out.parts = self.primes, [m[rows] for m in self.parts]
        return out

    def scores(self, other: Residues) -> np.ndarray:
        """Exact inner products of all rows with all rows of the other."""
        digits: list[np.ndarray] = []
        for k, p in enumerate(self.primes):
            left, right = self.parts[k], other.parts[k]
            r = np.zeros((len(left), len(right)))
            for at in range(0, left.shape[1], DEPTH):
                r += _centred((left[:, at : at + DEPTH] @ right[:, at : at + DEPTH].T).astype(np.float64), p)
            for d, q in zip(digits, self.primes, strict=False):
                r = _centred((r - d) * pow(q, -1, p), p)
            digits.append(_centred(r, p))
        value = digits[-1].astype(np.int64)
        for d, p in zip(digits[-2::-1], self.primes[-2::-1], strict=True):
            value = value * p + d.astype(np.int64)
        return value


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _first(group: np.ndarray, k: int) -> np.ndarray:
    """The first k places of each run of equal values."""
    head = np.append(True, group[1:] != group[:-1])[: len(group)]
    start = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0)) if len(group) else head
    return np.flatnonzero(np.arange(len(group)) - start < k)


def _best(parts: list[tuple], keys: int, k: int) -> list[np.ndarray]:
    """Columns (keys..., row, score) of all parts: the k highest scores of each key, equal ones in order of the row."""
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort((cols[keys], -cols[keys + 1], *reversed(cols[:keys])))
    cols = [c[order] for c in cols]
    group = np.cumsum(np.append(False, np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0))) if len(order) else cols[0]
    pick = _first(group, k)
    return [c[pick] for c in cols]


def _peaks(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the k highest entries of each row, the first of equal ones; least values are no entries."""
    none, found = np.iinfo(np.int64).min, []
    for _ in range(min(k, score.shape[1])):
        at = score.argmax(1)
        row = np.arange(len(score))
        value = score[row, at]
        found.append((row, at, value))
        score[row, at] = none
    row, at, value = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = value > none
    return row[keep], at[keep], value[keep]


class Table:
    """Rows of one tile or block in the order of ties: id, then row number."""

    def __init__(self, table: pa.Table, width: int, primes: list[int]):
        ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
        order = np.lexsort((table.column("row").to_numpy(), ids))
        table = table.take(pa.array(order))
        self.vec_id, self.row, self.label = table.column("vec_id"), table.column("row").to_numpy(), table.column("label").to_numpy()
        self.residues = Residues(_matrix(table.column("vector").combine_chunks(), width), primes)
        self.table = table


def _positives(rows: Table, anchors: Table, k: int) -> list[np.ndarray]:
    """(anchor, row, score): each anchor's k best other rows of its label."""
    parts = [(np.zeros(0, np.int64),) * 3]
    for label in np.unique(anchors.label):
        mine, same = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        step = max(1, min(len(same), 4096))
        for i in range(0, len(mine), max(1, SCORES // step)):
            own = mine[i : i + max(1, SCORES // step)]
            for j in range(0, len(same), step):
                cols = same[j : j + step]
                score = anchors.residues.some(own).scores(rows.residues.some(cols))
                score[anchors.row[own][:, None] == rows.row[cols][None, :]] = np.iinfo(np.int64).min
                a, at, value = _peaks(score, k)
                parts.append((own[a], cols[at], value))
    return _best(parts, 1, k)


def _negatives(rows: Table, anchors: Table, k: int) -> list[np.ndarray]:
    """(anchor, positive, row, score): the k best rows of other labels in each positive's window."""
    bounds = anchors.table.column("windows").combine_chunks()
    size = np.diff(bounds.offsets.to_numpy())
    flat = bounds.flatten()
    low, high = (np.zeros((len(size), int(size.max(initial=0))), np.int64) for _ in range(2))
    low[:], high[:] = 1, 0
    at = (np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    low[at], high[at] = flat.field("low").to_numpy(), flat.field("high").to_numpy()
    ranks = np.zeros(low.shape, np.int64)
    ranks[at] = flat.field("positive").to_numpy()
    least = np.where(low <= high, low, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
    most = np.where(low <= high, high, np.iinfo(np.int64).min).max(1, initial=np.iinfo(np.int64).min)
    some = np.flatnonzero(least <= most)
    parts = [(np.zeros(0, np.int64),) * 4]
    for i in range(0, len(some), SCORES // 4096):
        own = some[i : i + SCORES // 4096]
        for j in range(0, len(rows.row), 4096):
            score = anchors.residues.some(own).scores(rows.residues.some(slice(j, j + 4096)))
            fits = (score >= least[own][:, None]) & (score <= most[own][:, None]) & (anchors.label[own][:, None] != rows.label[None, j : j + 4096])
            a, col = np.nonzero(fits)
            value = score[a, col]
            order = np.lexsort((col, -value, a))
            a, col, value = own[a[order]], col[order] + j, value[order]
            for p in range(low.shape[1]):
                inside = np.flatnonzero((value >= low[a, p]) & (value <= high[a, p]))
                pick = inside[_first(a[inside], k)]
                parts.append((a[pick], ranks[a[pick], p], col[pick], value[pick]))
    return _best(parts, 2, k)


class Grid:
    """Prepared vectors in tiles and blocks; ``vectors`` has vec_id, label, vector (integers) and anchor."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        small_batches(spark)
        self.vectors = staged(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
        size = F.array_max(F.transform("vector", F.abs))
        found = self.vectors.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("vector")).alias("width"), F.max(size).alias("most")).first()
        self.width, bound = max(1, found.width or 1), max(1, found.width or 1) * (found.most or 0) ** 2
        if bound >= 1 << 63:
            raise ValueError(f"scores up to {bound} do not fit 64 bits")
        self.primes = moduli(bound)
        self.tiles = max(12, found.n * self.width * 4 // TILE_BYTES)
        self.blocks = max(1, found.anchors * self.width * 4 // BLOCK_BYTES)

    def found(self, anchors: DataFrame, work: Callable, keys: int, schema: str) -> DataFrame:
        """``work`` on every (tile of all rows, block of anchors)."""
        width, primes, names = self.width, self.primes, [x.split()[0] for x in schema.split(", ")]
        place = F.xxhash64("row")
        rows = self.vectors.select("row", "vec_id", "label", "vector", F.pmod(place, F.lit(self.tiles)).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block"))
        anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of their own, as both sides come from one table
        anchors = anchors.withColumn("block", F.pmod(place, F.lit(self.blocks)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.tiles - 1).cast("long"))))

        def tile(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table([pa.array([], pa.int64())] * len(names), names=names)
            rows, block = Table(left, width, primes), Table(right, width, primes)
            *key, at, score = work(rows, block)
            own = [pa.array(block.row[key[0]]), *map(pa.array, key[1:])]
            return pa.table([*own, rows.vec_id.take(pa.array(at)), pa.array(rows.row[at]), pa.array(score)], names=names)

        n = max(12, self.tiles * self.blocks)
        pairs = rows.repartition(n, "tile", "block").groupBy("tile", "block").cogroup(anchors.repartition(n, "tile", "block").groupBy("tile", "block"))
        return pairs.applyInArrow(tile, schema)


def quantised(df: DataFrame, scale: float = 256.0, column: str = "embedding") -> DataFrame:
    """Rows that take part, with ``vector``: floor(scale * x) of every component."""
    whole = ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(F.col("label").isNotNull() & F.col(column).isNotNull() & whole)
    return rows.withColumn("vector", F.transform(column, lambda x: F.floor(x.cast("double") * scale)))


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels
    whose score is from ``low`` to ``high`` percent of the positive's: ids, ranks from 1, and scores."""
    grid = Grid(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector", F.coalesce(anchor, F.lit(False)).alias("anchor")))
    anchors = grid.vectors.filter("anchor").select("row", "vec_id", "label", "vector")
    ties = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")]
    best = grid.found(anchors, lambda r, a: _positives(r, a, positives), 1, "anchor long, vec_id long, row long, score long")
    best = best.withColumn("positive", F.row_number().over(Window.partitionBy("anchor").orderBy(*ties))).filter(F.col("positive") <= positives)
    best = staged(best.select("anchor", "positive", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole percent of 64-bit scores, in decimals: the least integer from low %, the largest to high %
    wide = F.col("positive_score").cast("decimal(25,0)")
    bounds = F.struct(F.col("positive").cast("long").alias("positive"), F.ceil(wide * low / 100).cast("long").alias("low"), F.floor(wide * high / 100).cast("long").alias("high"))
    windows = best.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(bounds)).alias("windows"))
    hit = grid.found(anchors.join(windows, "row"), lambda r, a: _negatives(r, a, negatives), 2, "anchor long, positive long, vec_id long, row long, score long")
    hit = hit.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*ties))).filter(F.col("rank") <= negatives)
    hit = hit.select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = hit.join(best.withColumn("positive", F.col("positive").cast("long")), ["anchor", "positive"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("positive").alias("positive_rank"))


def op11_residue_negatives(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other, o) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, p.place, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.other, s.o) AS rank
    FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score, place::BIGINT AS positive_rank FROM n
"""
