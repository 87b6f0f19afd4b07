"""Tables cut into sorted ranges: global order, row numbers and running sums without a task that holds a whole group.

A table is range-partitioned by all order columns, sorted and written once with the number of its range, as another
plan of the same ranges may draw other bounds.  What a range needs of those before it is carried by a second pass
over edges, at most two rows a range.  Rows equal in all order columns share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged

#: Bytes of input for a range, and the fewest ranges.
RANGE_BYTES, LEAST = 64 << 20, 4
#: Ranges whose sums are added up together before the sums of such blocks are.
BLOCK = 1024
_ID, _PLACE = 33, (1 << 33) - 1


def input_bytes(df: DataFrame) -> int:
    """Bytes of all tables that ``df`` reads; sources of unknown size count 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 2**60)


def range_count(df: DataFrame) -> int:
    return max(LEAST, input_bytes(df) // RANGE_BYTES)


def ranged(df: DataFrame, *order: str | Column, ranges: int | None = None) -> DataFrame:
    """``df`` in sorted ranges of the order, with ``__range`` and ``__at``, the place in the range from 0."""
    rows = df.repartitionByRange(ranges or range_count(df), *order).sortWithinPartitions(*order)
    rows = staged(rows.withColumn("__id", F.monotonically_increasing_id()), "ranges")
    return rows.select("*", F.shiftright("__id", _ID).alias("__range"), F.col("__id").bitwiseAND(F.lit(_PLACE)).alias("__at")).drop("__id")


def edges(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """The first and the last group of each range: ``__range``, ``__key`` and the sums over that part of the group.

    Only these groups can go on in another range.
    """
    key = (F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))).alias("__key")
    parts = rows.groupBy("__range", key).agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), *[c.alias(n) for n, c in sums.items()])
    part = F.struct("__key", *sums)
    both = parts.groupBy("__range").agg(F.min_by(part, "__first").alias("a"), F.max_by(part, "__last").alias("b"))
    return both.select("__range", F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select("__range", "e.*")


def sums_before(parts: DataFrame, names: list[str]) -> DataFrame:
    """``parts`` with each sum replaced by that over the same key's parts in earlier ranges, in two levels."""
    parts = parts.withColumn("__block", F.floor(F.col("__range") / BLOCK))
    inner = Window.partitionBy("__key", "__block").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("__key", "__block").agg(*[F.sum(n).alias(n) for n in names])
    blocks = blocks.select("__key", "__block", *[F.coalesce(F.sum(n).over(outer), F.lit(0)).alias(f"__{n}") for n in names])
    near = parts.select("__range", "__key", "__block", *[F.coalesce(F.sum(n).over(inner), F.lit(0)).alias(n) for n in names])
    return near.join(blocks, ["__key", "__block"]).select("__range", "__key", *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in names])


def running_sums(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each name, the sum of a column over all rows of the same keys that come earlier in the order.

    The first group of a range is the only one that began in an earlier one, so one row a range is broadcast.
    """
    rows = ranged(df, *keys, *order)
    names = list(sums)
    parts = edges(rows, keys, {n: F.sum(c) for n, c in sums.items()})
    starts = sums_before(parts, names)
    some = F.lit(False)
    for n in names:
        some = some | (F.col(n) != 0)
    starts = starts.filter(some).select("__range", F.col("__key").alias("__of"), *[F.col(n).alias(f"__{n}") for n in names])
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    inside = Window.partitionBy("__range", "__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__key", key).select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    out = out.join(F.broadcast(starts), "__range", "left")
    for n in names:
        out = out.withColumn(n, F.col(n) + F.when(F.col("__key") == F.col("__of"), F.col(f"__{n}")).otherwise(F.lit(0)))
    return out.drop("__range", "__at", "__key", "__of", *[f"__{n}" for n in names])


def row_numbers(df: DataFrame, number: str, *order: str | Column, ranges: int | None = None) -> DataFrame:
    """``df`` with its row numbers from 0 in the given order over the whole table."""
    rows = ranged(df, *order, ranges=ranges)
    starts = sums_before(edges(rows, [], {"__start": F.count("*")}), ["__start"]).select("__range", "__start")
    return rows.join(F.broadcast(starts), "__range").withColumn(number, F.col("__start") + F.col("__at")).drop("__range", "__at", "__start")
