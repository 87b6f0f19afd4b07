"""Incremental runs over source files with a manifest: what is done is skipped, what changed is done again.

The manifest has a row for each shard (source file) and run: fingerprint of the file (path, length, time of change), hash
of the settings, folder of its output, and its counts.  A shard is skipped if its latest row has the same fingerprint
and settings.  Output goes to a folder of its run, and manifest rows are written last, so that a run that dies leaves
nothing that readers see, and the next one does its shards again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "shard string, fingerprint string, settings string, run string, number long, rows_in long, rows_out long, parse_errors long"


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def source_files(spark: SparkSession, source: str) -> DataFrame:
    """(shard, fingerprint) of the files of a path or pattern; contents are not read."""
    files = spark.read.format("binaryFile").load(source).select("path", "length", F.unix_micros("modificationTime").alias("changed"))
    return files.select(F.col("path").alias("shard"), F.sha2(F.concat_ws("|", "path", "length", "changed"), 256).alias("fingerprint"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each shard."""
    try:
        rows = spark.read.schema(ROW).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ROW)
    latest = Window.partitionBy("shard").orderBy(F.desc("number"))
    return rows.withColumn("place", F.row_number().over(latest)).filter("place = 1").drop("place")


def run_incremental(
    spark: SparkSession, source: str, transform: Callable[[DataFrame, dict], DataFrame], settings: dict, target: str, manifest: str,
    kind: str = "parquet", overwrite: bool = False, errors: str | None = None,
) -> DataFrame:
    """Do what is new or changed and report all shards: shard, status, rows_in, rows_out, parse_errors.

    ``transform`` gets the rows of the shards to do, with their settings, and must keep ``__shard``; ``errors`` names a
    column of its result that is not empty where parsing failed.
    """
    wanted, known = settings_hash(settings), read_manifest(spark, manifest)
    same = (F.col("old.fingerprint") == F.col("new.fingerprint")) & (F.col("old.settings") == wanted) & F.lit(not overwrite)
    state = source_files(spark, source).alias("new").join(known.alias("old"), "shard", "left").select("shard", "new.fingerprint", F.coalesce(same, F.lit(False)).alias("done"), F.col("old.run").isNotNull().alias("seen"), "number")
    todo = state.filter("NOT done").collect()
    if todo:
        run, number = uuid.uuid4().hex, 1 + max((r.number or 0 for r in state.select("number").collect()), default=0)
        rows = spark.read.format(kind).load([r.shard for r in todo]).withColumn("__shard", F.col("_metadata.file_path"))
        out = transform(rows, settings)
        out.withColumn("shard_key", F.sha2("__shard", 256)).write.option("compression", "zstd").partitionBy("shard_key").parquet(f"{target}/run={run}")
        bad = F.count_if(F.coalesce(F.col(errors) != "", F.lit(False))) if errors else F.lit(0).cast("long")
        before = rows.groupBy(F.col("__shard").alias("shard")).agg(F.count("*").alias("rows_in"))
        after = _output(spark, target, [run]).groupBy(F.col("__shard").alias("shard")).agg(F.count("*").alias("rows_out"), bad.alias("parse_errors"))
        done = spark.createDataFrame([(r.shard, r.fingerprint, wanted, run, number) for r in todo], "shard string, fingerprint string, settings string, run string, number long")
        zero = F.lit(0).cast("long")
        done = done.join(before, "shard", "left").join(after, "shard", "left")
        done.select("shard", "fingerprint", "settings", "run", "number", *[F.coalesce(c, zero).alias(c) for c in ("rows_in", "rows_out", "parse_errors")]).coalesce(1).write.mode("append").parquet(manifest)
    status = {r.shard: "redone" if r.seen else "processed" for r in todo}
    told = spark.createDataFrame(list(status.items()), "shard string, status string")
    present = state.select("shard")
    report = read_manifest(spark, manifest).join(present, "shard", "left_semi").join(told, "shard", "left")
    return report.select("shard", F.coalesce("status", F.lit("skipped_existing")).alias("status"), "rows_in", "rows_out", "parse_errors")


def _output(spark: SparkSession, target: str, runs: list[str]) -> DataFrame:
    return spark.read.option("basePath", target).parquet(*[f"{target}/run={r}" for r in runs])


def read_output(spark: SparkSession, target: str, manifest: str, source: str | None = None) -> DataFrame:
    """Rows of the latest run of each shard; with ``source``, of those that are still there."""
    latest = read_manifest(spark, manifest)
    if source:
        latest = latest.join(source_files(spark, source), "shard", "left_semi")
    latest = latest.select("run", F.sha2("shard", 256).alias("shard_key"))
    runs = [r.run for r in latest.select("run").distinct().collect()]
    return _output(spark, target, runs).join(latest, ["run", "shard_key"], "left_semi").drop("run", "shard_key", "__shard")
