"""Assigning users to train, valid and test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import hash_split


def assign_splits(df: DataFrame, split_map: DataFrame | None, unknown: str = "drop") -> DataFrame:
    """``df`` with a split by user: from the map, else by hash (``unknown='hash'``) or not at all (``'drop'``)."""
    if unknown not in ("drop", "hash"):
        raise ValueError(f"unknown policy: {unknown}")
    if split_map is None:
        return df.withColumn("split", hash_split(F.col("user_id")))
    if unknown == "drop":
        return df.join(split_map, "user_id")
    return df.join(split_map, "user_id", "left").withColumn("split", F.coalesce("split", hash_split(F.col("user_id"))))
