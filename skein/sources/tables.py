"""Tables of a data folder in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App events: user_id, event_name, event_json, event_datetime, event_timestamp, session_id (the day)."""
    raw = table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "props"])
    return raw.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("event_name"),
        F.coalesce("props", F.lit("{}")).alias("event_json"),
        F.col("ts").alias("event_datetime"),
        epoch_seconds(F.col("ts")).alias("event_timestamp"),
        F.to_date("ts").cast("string").alias("session_id"),
    )
