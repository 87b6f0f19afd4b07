"""Tables of the final report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_by(df: DataFrame, keys: list[str], metric: str, tie: str = "model_name") -> DataFrame:
    """The row with the largest metric of each group; NaN and null come last, ties go to the smaller name."""
    value = F.nanvl(F.col(metric), F.lit(None).cast("double"))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value), tie)
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def test_of_valid_winners(metrics: DataFrame) -> DataFrame:
    """Test rows of the models that are best on the validation rows of their cell."""
    winners = best_by(metrics.filter("split = 'valid'"), ["target", "prefix_len"], "roc_auc")
    return metrics.filter("split = 'test'").join(winners.select("target", "prefix_len", "model_name").distinct(), ["target", "prefix_len", "model_name"], "left_semi")


def pivot_mean(df: DataFrame, rows: list[str], column: str, values: list[str], metric: str) -> DataFrame:
    return df.groupBy(*rows).pivot(column, values).agg(F.avg(metric))


def split_gap(metrics: DataFrame, metric: str) -> DataFrame:
    """Mean metric by split, and validation minus test."""
    wide = pivot_mean(metrics, ["target", "prefix_len", "model_name"], "split", ["valid", "test"], metric)
    return wide.withColumn("gap", F.col("valid") - F.col("test"))


def lift(metrics: DataFrame, metric: str, baseline: str) -> DataFrame:
    """Metric of each row minus that of the baseline model in the same cell."""
    cell = ["target", "prefix_len", "split"]
    base = metrics.filter(F.col("model_name") == baseline).select(*cell, F.col(metric).alias("baseline"))
    return metrics.join(base, cell).select(*cell, "model_name", (F.col(metric) - F.col("baseline")).alias("lift"))


def labelled(df: DataFrame, column: str, names: DataFrame, out: str) -> DataFrame:
    """A display name from a (name, label) table, else the name itself."""
    joined = df.join(names.select(F.col("name").alias(column), F.col("label").alias("__label")), column, "left")
    return joined.withColumn(out, F.coalesce("__label", column)).drop("__label")


def best_variant(metrics: DataFrame, models: list[str], metric: str = "pr_auc") -> DataFrame:
    return best_by(metrics.filter(F.col("model_name").isin(*models)), ["target"], metric)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def tagged_union(frames: dict[str, DataFrame], column: str = "split") -> DataFrame:
    return union_all([df.withColumn(column, F.lit(tag)) for tag, df in frames.items()])


def balanced_head(df: DataFrame, most: int, keys: list[str], order: list[str]) -> DataFrame:
    """At most ``most`` rows, about as many of each group."""
    groups = df.select(*keys).distinct().count()
    each = -(-most // max(1, groups))
    w = Window.partitionBy(*keys).orderBy(*order)
    head = df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= each).drop("__n")
    return head.orderBy(*keys, *order).limit(most)
