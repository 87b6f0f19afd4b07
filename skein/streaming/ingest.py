"""Resumable ingest: a file stream that takes what is new, once, and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_new_files(
    spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str,
    audit: str | None = None, kind: str = "parquet", options: dict | None = None,
) -> None:
    """Files of ``source`` not seen before, through ``transform``, appended to ``target``.

    The checkpoint remembers files, so that a second run reads nothing and a new file is picked up.
    With ``audit``, each batch also appends one row of rows in and out.  A batch that is run again
    after a failure overwrites its own folders.
    """
    stream = spark.readStream.format(kind).options(**(options or {})).schema(schema).load(source)

    def batch(df: DataFrame, number: int) -> None:
        rows = transform(df)
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch={number}")
        if audit:
            counted = df.agg(F.count("*").alias("rows_in")).crossJoin(df.sparkSession.read.parquet(f"{target}/batch={number}").agg(F.count("*").alias("rows_out")))
            counted.write.mode("overwrite").parquet(f"{audit}/batch={number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
