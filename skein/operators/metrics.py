"""Ranking and binary metrics, exact and in one or two shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import clip_probability
from .ranged import running_sums


def rank_metrics(predicted: DataFrame, name: str, k: int = 10) -> DataFrame:
    """Mean reciprocal rank and hits of the target in the first k predictions, by split and prefix length."""
    place = F.array_position(F.slice("predictions", 1, k), F.col("next_event_token_id"))
    rows = predicted.filter(F.col("next_event_token_id").isNotNull()).withColumn("place", place)
    return rows.groupBy("split", "prefix_len").agg(
        F.lit(name).alias("model_name"),
        F.avg(F.when(F.col("place") > 0, 1.0 / F.col("place")).otherwise(0.0)).alias("mrr_at_10"),
        F.avg(((F.col("place") > 0) & (F.col("place") <= 5)).cast("double")).alias("hit_at_5"),
        F.avg((F.col("place") > 0).cast("double")).alias("hit_at_10"),
        F.count("*").alias("num_rows"),
    )


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    total = F.sum(weight)
    return df.agg(F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(0.0).alias("mean"))


def topk_scores(scores: DataFrame, labels: DataFrame, row: str, item: str, score: str, k: int = 10) -> DataFrame:
    """Hit rate and mean reciprocal rank of (row, item, score) against (row, label); labels below 0 are ignored."""
    order = Window.partitionBy(row).orderBy(F.desc(score), item)
    top = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    hits = top.select(row, F.col(item).alias("label"), "rank")
    rows = labels.filter(F.col("label") >= 0).join(hits, [row, "label"], "left")
    return rows.agg(
        F.count("*").alias("num_rows"), F.avg(F.col("rank").isNotNull().cast("double")).alias("hit"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr")
    )


def binary_metrics(df: DataFrame, keys: list[str], label: str = "label", prob: str = "prob", threshold: float = 0.5) -> DataFrame:
    """ROC-AUC, average precision, F1, log loss, rows and positive rate by group.

    Scores are first counted by distinct value, so ties are exact; the sums of all higher scores are running
    sums over sorted ranges, so that no task holds a whole group.  ROC-AUC is null if a group has one class.
    """
    y, p = F.col(label), F.col(prob)
    loss = -(y * F.ln(clip_probability(p)) + (1 - y) * F.ln(1 - clip_probability(p)))
    hit = (p >= threshold).cast("int")
    per = df.groupBy(*keys, p.alias("score")).agg(
        F.count("*").alias("n"), F.sum(y).alias("pos"), F.sum(loss).alias("loss"), F.sum(hit * y).alias("tp"), F.sum(hit).alias("flagged")
    )
    per = running_sums(per, keys, [F.desc("score")], {"n_above": "n", "pos_above": "pos"})
    n, pos = F.sum("n"), F.sum("pos")
    below = F.sum(F.col("pos") * (F.col("n_above") + (F.col("n") - 1) / 2))  # of each positive, the rows above it and half of those beside it
    return per.groupBy(*keys).agg(
        n.alias("num_rows"),
        (pos / n).alias("positive_rate"),
        F.when((pos > 0) & (pos < n), (pos * n - below - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("roc_auc"),
        F.when(pos > 0, F.sum(F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("n_above") + F.col("n"))) / pos).otherwise(0.0).alias("pr_auc"),
        F.when(F.sum("flagged") + pos > 0, 2 * F.sum("tp") / (F.sum("flagged") + pos)).otherwise(0.0).alias("f1"),
        (F.sum("loss") / n).alias("logloss"),
    )
