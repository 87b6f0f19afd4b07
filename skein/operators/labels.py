"""Retention labels, checked joins of labels, and metadata columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import DAY

METADATA = ("user_id", "split", "prefix_len", "num_events_total", "prefix_start_ts", "prefix_end_ts", "next_event_token_id")


def window_labels(events: DataFrame, days: list[int]) -> DataFrame:
    """Events with, per X in ``days``: whether the user has an event in [t + X days, t + X + 1 days).

    A RANGE frame does this in the shuffle that ordered the user's events; the label is null where
    the data end before the window does.
    """
    last = events.agg(F.max("event_timestamp").alias("dataset_max_ts"))
    df = events.join(F.broadcast(last))
    by_time = Window.partitionBy("user_id").orderBy("event_timestamp")
    for x in days:
        seen = F.count("*").over(by_time.rangeBetween(x * DAY, (x + 1) * DAY - 1)) > 0
        available = F.col("dataset_max_ts") >= F.col("event_timestamp") + (x + 1) * DAY
        df = df.withColumn(f"label_available_retention_{x}d", available).withColumn(f"label_retention_{x}d", F.when(available, seen.cast("int")))
    return df.drop("dataset_max_ts")


def prefix_labels(seq: DataFrame, lengths: list[int], days: list[int]) -> DataFrame:
    """(user_id, prefix_len, labels): the window labels at the last event of each prefix."""
    rows = window_labels(seq, days).filter(F.col("rn").isin(*lengths) & (F.col("num_events_total") >= F.col("rn")))
    return rows.select("user_id", F.col("rn").cast("int").alias("prefix_len"), *[c for c in rows.columns if c.startswith("label_")])


def duration_labels(users: DataFrame, days: list[int]) -> DataFrame:
    """Users with, per X: whether first and last event lie at least X days apart."""
    span = F.col("last_event_ts") - F.col("first_event_ts")
    return users.select("*", *[(span >= x * DAY).cast("int").alias(f"label_retention_{x}d") for x in days])


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails if a key repeats on the right or a left row has no match."""
    counted = right.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    once = F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("a key of the labels repeats")).cast("boolean"))
    joined = left.join(counted, keys, "left")
    met = F.when(F.col("__n").isNull(), F.raise_error(F.lit("a row has no label")).cast("boolean")).otherwise(once)
    return joined.filter(met).drop("__n")


def drop_labels(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("label_") and c not in keep])


def metadata_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c in METADATA or c.startswith("label_")])
