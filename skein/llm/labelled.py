"""Bounded, repeatable samples of labelled documents for the small models trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id has none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def held_out(folds: int, fold: int) -> Column:
    """True on the held-out fold; a null id counts as held out, as it can carry no label."""
    return F.coalesce(id_remainder(folds) == fold, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int, most_bytes: int) -> list[tuple[str, int]]:
    """At most ``most`` (text, label) rows outside the held-out fold, in the order of a hash of the id, however many rows an id has.

    Each class gives at most half of them, and texts longer than ``most_bytes`` are left to scoring.
    """
    marked = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label")).filter(~held_out(folds, fold))
    marked = marked.withColumn("order", F.xxhash64("doc_id"))
    parts = [marked.filter(F.col("label") == v).orderBy("order", "doc_id").limit(most // 2) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.filter(F.octet_length("text") <= most_bytes).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # an id may have many rows: the bound holds for rows
    first = [texts.filter(F.col("label") == v).orderBy("order", "doc_id", "text").limit(most // 2) for v in (0, 1)]
    rows = first[0].unionByName(first[1]).orderBy("order", "doc_id", "text").select("text", "label").collect()
    return [(r.text, int(r.label)) for r in rows]
