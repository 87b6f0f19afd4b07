"""Reading raw event files and writing result tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from ..operators.ranged import range_count

#: Texts that stand for a missing value in a raw file.
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SPLIT_ALIASES = {"train": "train", "trn": "train", "valid": "valid", "val": "valid", "validation": "valid", "test": "test", "tst": "test"}


def read_raw_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """A CSV with a header as text columns; a byte order mark is dropped, missing-value texts are null.

    Files stay splittable unless fields hold line breaks (``multi_line``).
    """
    header = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path).columns
    names = [c.lstrip("﻿").strip() for c in header]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).option("enforceSchema", True).schema(schema).csv(path)
    df = require_columns(df, columns)
    return df.select(*[F.when(F.col(c).isin(*NA_STRINGS), None).otherwise(F.col(c)).alias(c) for c in columns])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def clean_events(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Raw text columns to typed events; ``names`` maps user_id, event_name, event_json, event_datetime,
    event_timestamp and session_id to the raw columns.  Rows without user, name or a time that parses go."""
    df = raw.select(*[F.col(names[c]).alias(c) for c in ("user_id", "event_name", "event_json", "event_datetime", "event_timestamp", "session_id")])
    df = df.na.drop(subset=["user_id", "event_name", "event_timestamp"])
    typed = df.select(
        "user_id",
        py_strip(F.col("event_name")).alias("event_name"),
        F.coalesce("event_json", F.lit("{}")).alias("event_json"),
        F.expr("try_cast(event_datetime AS timestamp_ntz)").alias("event_datetime"),
        F.rint(F.expr("try_cast(event_timestamp AS double)")).cast("long").alias("event_timestamp"),
        "session_id",
    )
    return typed.na.drop(subset=["event_timestamp", "event_datetime"])


def ingest_audit(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: rows in, out and dropped."""
    counts = raw.agg(F.count("*").alias("rows_in")).crossJoin(F.broadcast(clean.agg(F.count("*").alias("rows_out"))))
    return counts.withColumn("rows_dropped", F.col("rows_in") - F.col("rows_out"))


def file_order() -> Column:
    """Rows of a file source by path, then by their place in the file, whatever the order in which splits are read.

    Splits of a file are told by their first byte, rows of one split by the order in which a task reads them.
    """
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def has_files(df: DataFrame) -> bool:
    """Whether the rows still know the file they come from."""
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:
        return False
    return True


def clean_split_map(df: DataFrame, user_col: str, split_col: str, order: Column | None = None) -> DataFrame:
    """(user_id, split) with aliases resolved; unknown splits go; of several rows of a user the last one holds.

    The last is that of the largest ``order``: by default ``file_order`` if the rows come straight from files, else the
    row's place among the partitions.
    """
    alias = F.create_map(*[F.lit(x) for pair in SPLIT_ALIASES.items() for x in pair])
    if order is None:
        order = file_order() if has_files(df) else F.monotonically_increasing_id()
    place = order
    rows = df.select(F.col(user_col).cast("string").alias("user_id"), F.lower(py_strip(F.col(split_col))).alias("raw"), place.alias("place"))
    rows = rows.select("user_id", alias[F.col("raw")].alias("split"), "place").na.drop(subset=["user_id", "split"])
    return rows.groupBy("user_id").agg(F.max_by("split", "place").alias("split"))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 0, by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def sorted_export(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Events in the order user, time, session, token: ranges of all four, so that a user may span several, each sorted.

    There are as many ranges as the bytes of the tables behind ``df`` ask for.
    """
    order = ["user_id", "event_timestamp", F.asc_nulls_last("session_id"), "event_token_id"]
    return df.repartitionByRange(partitions or range_count(df), *order).sortWithinPartitions(*order)
