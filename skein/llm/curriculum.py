"""Mixing sources to target weights along a time-varying curriculum, with SQL functions only.

Each source (null is a source of its own, ranked last) has a weight and a linear weight schedule
over training time 0..1.  The integral of the schedule is the source's cumulative token demand;
inverting it at a document's cumulative token count gives the document's training position, and
documents are range-sorted by that position.

Cumulative counts inside a source come from two levels (md5 buckets, then rows of one bucket), so
that a source holding most rows is spread over many tasks.  Documents without words have size 0
and are never taken.  Repeated rows count as often as they occur; ties in the order fall to the id.
An empty table gives an empty result.  Other columns are carried by ``training_order`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Start and end of each weight class's linear schedule, relative to its mean weight.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Hex digits of the md5 of the id that form the first level of the cumulative sums.
BUCKET_DIGITS = 3


def _cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def _numbered(sources: DataFrame) -> DataFrame:
    """The staged table of sources with ``rank``: 0, 1, ... by code point, null last.

    Sources are dealt by range once; a row's number is its place in its range after the sizes of the ranges before.
    """
    ranged = staged(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    return staged(ranged.withColumn("place", place).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("place") - 1).drop("part", "place", "offset"), "ranked")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source_key, source, size) rows to one row per source with rank, weight, source_size and target.

    The budget is shared by weight; sources above ``most`` times their size stop there and the rest is
    shared again among the others, until none is above.  Each round is one pair of sums over the table
    of sources, and the level, a target per weight, only rises.
    """
    ranked = _numbered(sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size")))
    w = ranked.withColumn("weight", _cycle(weights, F.col("rank"))).withColumn("stop", most * F.col("source_size"))
    level = 0.0
    while True:
        stops = F.col("stop") <= level * F.col("weight")
        found = w.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(stops, F.col("stop"))).alias("stopped"), F.sum(F.when(~stops, F.col("weight"))).alias("open")
        ).first()
        if not found.open:
            break
        after = (budget * found["all"] - (found.stopped or 0.0)) / found.open
        if after <= level:
            break
        level = after
    return w.select("source_key", "rank", "weight", "source_size", F.least("stop", level * F.col("weight")).alias("target"))


def _source_key() -> Column:
    """The source, told apart from null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def _mark() -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _demand_inverse(u: Column, start: Column, end: Column) -> Column:
    """Time at which the share ``u`` of a source is used up under a rate going linearly from start to end (mean 1)."""
    curved = (F.sqrt(start * start + 2.0 * (end - start) * u) - start) / (end - start)
    return F.when(start == end, u).otherwise(curved)


def plan_mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, budget: float = 1.5, most: float = 2.0, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, position.

    Every full pass takes all documents; the last, partial pass takes documents in md5 order until
    the target.  The document at the cut gives its leading words (``whole=False``) or is taken
    when more than half of it lies before the cut (``whole=True``).  ``position`` is the training
    time of the first copy, null where nothing is taken.
    """
    thin = docs.select(
        "doc_id",
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order_key"),
        _mark().alias("mark"),
    )
    thin = thin.withColumn("source_key", _source_key()).withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    thin = staged(thin, "sizes")
    sums = thin.groupBy("source_key", "source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(sums, weights, budget, most)
    offset = F.coalesce(F.sum("size").over(Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = sums.select("source_key", "bucket", offset.alias("offset")).join(targets, "source_key")
    inside = F.coalesce(
        F.sum("size").over(Window.partitionBy("source_key", "bucket").orderBy("order_key", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    rows = thin.withColumn("inside", inside).join(buckets, ["source_key", "bucket"])
    rows = rows.withColumn("begin", F.col("offset") + F.col("inside"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("passes", passes).withColumn("cut", F.col("target") - F.col("passes") * F.col("source_size"))
    if whole:
        part = F.when(F.col("begin") + F.col("size") / 2.0 < F.col("cut"), F.col("size")).otherwise(F.lit(0))
    else:
        part = F.least(F.col("size"), F.greatest(F.lit(0), F.floor(F.col("cut")) - F.col("begin")))
    rows = rows.withColumn("part", part.cast("long")).withColumn("taken", (F.col("passes") * F.col("size") + F.col("part")).cast("long"))
    u = F.least(F.lit(1.0), F.col("begin") / F.col("target"))
    start, end = (_cycle(tuple(s[i] for s in schedules), F.col("rank")) for i in (0, 1))
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        (F.col("passes") + (F.col("part") > 0).cast("long")).cast("int").alias("copies"),
        F.when(F.col("taken") > 0, F.round(_demand_inverse(u, start, end), 9)).alias("position"),
        F.struct("begin", "rank", start.alias("start"), end.alias("end")).alias("place"),
        "mark",
        "source_key",
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The plan of the mix, range-sorted by training position; documents not taken come last."""
    return plan_mix(docs, **how).drop("place", "mark", "source_key").orderBy(F.asc_nulls_last("position"), "doc_id")


def training_order(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents with all their columns, one row per copy, range-sorted by training position.

    Documents are taken whole.  Rows alike in id, text and source are numbered, in the plan by their
    place in the source, so that each is taken as often as its own plan says.  Null ids and texts are
    mixed like others; an empty table gives an empty result; other columns are carried untouched.
    """
    plan = plan_mix(docs, whole=True, **how)
    alike = Window.partitionBy("doc_id", "mark", "source_key")
    plan = plan.withColumn("nth", F.row_number().over(alike.orderBy("place.begin"))).filter("copies > 0")
    u = F.least(F.lit(1.0), (F.col("place.begin") + F.col("copy") * F.col("source_size")) / F.col("target"))
    copies = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    copies = copies.select("doc_id", "mark", "source_key", "nth", "copy", _demand_inverse(u, F.col("place.start"), F.col("place.end")).alias("position"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", _mark().alias("mark"), _source_key().alias("source_key"))
    rows = rows.withColumn("nth", F.row_number().over(alike.orderBy(F.lit(0))))
    same = F.lit(True)
    for name in ("doc_id", "mark", "source_key", "nth"):
        same = same & rows[name].eqNullSafe(copies[name])
    joined = rows.join(copies, same).select("row", copies["position"], copies["doc_id"], copies["copy"])
    return joined.orderBy("position", "doc_id", "copy").select("row.*")


def op4_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS stop FROM r),
l AS (SELECT 1.5::DOUBLE * sum(source_size) / sum(weight) AS level FROM w
  UNION ALL
  SELECT after FROM (SELECT l.level, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(stop) FILTER (stop <= l.level * weight), 0))
                                             / sum(weight) FILTER (stop > l.level * weight) FROM w) AS after FROM l) WHERE after > level),
t AS (SELECT w.*, least(stop, weight * (SELECT max(level) FROM l)) AS target FROM w),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rk,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, least(size, greatest(0, floor(target - passes * source_size) - begin))::BIGINT AS part FROM b),
q AS (SELECT *, passes * size + part AS taken, least(1.0::DOUBLE, begin / target) AS u,
        CASE rk % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0 ELSE 0.5 END AS a, CASE rk % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0 ELSE 1.5 END AS z FROM p)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, CAST(passes + CASE WHEN part > 0 THEN 1 ELSE 0 END AS INTEGER) AS copies,
  CASE WHEN taken > 0 THEN round(CASE WHEN a = z THEN u ELSE (sqrt(a * a + 2.0 * (z - a) * u) - a) / (z - a) END, 9) END AS position
FROM q
"""
