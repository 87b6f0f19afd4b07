"""First-order transition statistics and the predictors and features made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import entropy


def last_token(df: DataFrame) -> DataFrame:
    return df.withColumn("last_event_token_id", F.try_element_at("event_token_ids", F.lit(-1)))


def transitions(train: DataFrame) -> DataFrame:
    """(last, next, count) of rows that have both."""
    rows = last_token(train).filter(F.col("next_event_token_id").isNotNull() & F.col("last_event_token_id").isNotNull())
    return rows.groupBy("last_event_token_id", "next_event_token_id").agg(F.count("*").alias("count"))


def markov_stats(train: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent successors of each token, with their share of all its transitions."""
    by_last = Window.partitionBy("last_event_token_id")
    rank = F.row_number().over(by_last.orderBy(F.desc("count"), "next_event_token_id"))
    rows = transitions(train).withColumn("total_count", F.sum("count").over(by_last)).withColumn("rank", rank)
    return rows.filter(F.col("rank") <= k).withColumn("prob", F.col("count") / F.col("total_count"))


def popular(train: DataFrame, k: int = 10) -> DataFrame:
    """(next, count) of the k most frequent next tokens."""
    counts = train.filter(F.col("next_event_token_id").isNotNull()).groupBy("next_event_token_id").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "next_event_token_id").limit(k)


def _popular_array(train: DataFrame, k: int) -> DataFrame:
    top = popular(train, k).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "next_event_token_id"))).alias("s"))
    return top.select(F.transform("s", lambda x: x["next_event_token_id"]).alias("popular"))


def successors(stats: DataFrame) -> DataFrame:
    """(last, succ): the ranked successors of each token as one array of (rank, next, count)."""
    item = F.struct("rank", F.col("next_event_token_id").alias("next"), "count")
    return stats.groupBy("last_event_token_id").agg(F.array_sort(F.collect_list(item)).alias("succ"))


def predict_popular(frame: DataFrame, train: DataFrame, k: int = 10) -> DataFrame:
    return frame.join(F.broadcast(_popular_array(train, k))).withColumnRenamed("popular", "predictions")


def predict_markov(frame: DataFrame, train: DataFrame, k: int = 10) -> DataFrame:
    """Successors of the last token, then popular tokens, cut to k; repeats are kept."""
    df = last_token(frame).join(successors(markov_stats(train, k)), "last_event_token_id", "left").join(F.broadcast(_popular_array(train, k)))
    own = F.coalesce(F.transform("succ", lambda x: x["next"]), F.array().cast("array<long>"))
    return df.withColumn("predictions", F.slice(F.concat(own, "popular"), 1, k)).drop("succ", "popular")


def markov_features(frame: DataFrame, stats: DataFrame) -> DataFrame:
    """Features of the top successors; here the total is that of the kept successors only."""
    df = last_token(frame).join(successors(stats), "last_event_token_id", "left")
    total = F.coalesce(F.aggregate("succ", F.lit(0).cast("long"), lambda s, x: s + x["count"]), F.lit(0).cast("long"))
    df = df.withColumn("__total", total)
    shares = F.transform("succ", lambda x: x["count"] / F.col("__total"))
    actual = F.get(F.filter("succ", lambda x: x["next"] == F.col("next_event_token_id")), F.lit(0))
    df = df.withColumn("__p", F.coalesce(shares, F.array().cast("array<double>"))).withColumn("__a", actual)
    return df.select(
        *frame.columns,
        F.col("__total").cast("double").alias("markov_last_total_count"),
        F.coalesce(F.get("__p", F.lit(0)), F.lit(0.0)).alias("markov_top1_prob"),
        entropy(F.col("__p")).alias("markov_top10_entropy"),
        (F.col("__a.count") / F.col("__total")).alias("markov_actual_prob"),
        F.col("__a.rank").cast("double").alias("markov_actual_rank"),
    )
