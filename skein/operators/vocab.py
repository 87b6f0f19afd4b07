"""Token frequencies, vocabularies and their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranged import row_numbers
from .skewed import HEAVY, spread_join

SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[MASK]", "[CLS]")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(token, count) of a text column or, flattened, of a column of text arrays; nulls are skipped."""
    c = F.col(column)
    tokens = df.select((F.explode(c) if isinstance(df.schema[column].dataType, T.ArrayType) else c).alias("token"))
    return tokens.filter(F.col("token").isNotNull()).groupBy("token").agg(F.count("*").alias("count"))


def build_vocab(freq: DataFrame, min_freq: int = 2, max_size: int | None = None, special=SPECIAL_TOKENS) -> DataFrame:
    """(token, id): special tokens first, then by falling count and token, cut to ``max_size``."""
    spark = freq.sparkSession
    kept = freq.filter((F.col("count") >= min_freq) & ~F.col("token").isin(*special))
    if max_size is not None:
        kept = kept.orderBy(F.desc("count"), "token").limit(max(0, max_size - len(special)))
    numbered = row_numbers(kept, "id", F.desc("count"), F.asc("token"))
    head = spark.createDataFrame([(t, i) for i, t in enumerate(special)], "token string, id long")
    return head.unionByName(numbered.select("token", (F.col("id") + len(special)).alias("id")))


def coverage(freq: DataFrame, vocab: DataFrame, special=SPECIAL_TOKENS) -> DataFrame:
    """One row of total, kept and out-of-vocabulary tokens and occurrences; the ratio is 0 for an empty table."""
    known = vocab.filter(~F.col("token").isin(*special)).select("token", F.lit(1).alias("known"))
    j = freq.join(known, "token", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    total, kept = F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(F.col("count") * F.col("known")), F.lit(0))
    return j.agg(
        F.count("*").alias("unique_total"),
        F.coalesce(F.sum("known"), F.lit(0)).alias("unique_kept"),
        (F.count("*") - F.coalesce(F.sum("known"), F.lit(0))).alias("unique_oov"),
        total.alias("occurrences_total"),
        kept.alias("occurrences_kept"),
        (total - kept).alias("occurrences_oov"),
        F.when(total > 0, kept / total).otherwise(0.0).alias("coverage_ratio"),
    )


def encode_tokens(events: DataFrame, vocab: DataFrame, column: str, out: str = "event_token_id", unknown: str = "[UNK]") -> DataFrame:
    """Events with the id of their token; tokens outside the vocabulary take the id of the unknown token.

    The smallest ids are the most frequent tokens, so these are the ones whose events are spread.
    """
    unk = vocab.filter(F.col("token") == unknown).select(F.col("id").alias("__unk"))
    ids = vocab.select(F.col("token").alias(column), F.col("id").alias("__id"))
    frequent = vocab.filter(F.col("id") < HEAVY).select(F.xxhash64("token").alias("heavy"))
    joined = spread_join(events, ids, column, "left", frequent).join(F.broadcast(unk))
    return joined.withColumn(out, F.coalesce("__id", "__unk")).drop("__id", "__unk")


def top_tokens(freq: DataFrame, k: int = 20) -> DataFrame:
    return freq.orderBy(F.desc("count"), "token").limit(k)
