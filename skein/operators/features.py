"""Tabular and hashed features of sequences."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markov import markov_features


def sequence_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tokens, repeats, entropy, session boundaries and gap statistics of each sequence.

    Token counts come from the long form, so that long sequences need no quadratic array work.
    """
    long = df.select(*keys, F.posexplode(F.arrays_zip("event_token_ids", "time_gap_ids", "session_flags")).alias("pos", "x"))
    flat = long.select(*keys, "x.event_token_ids", "x.time_gap_ids", "x.session_flags")
    by_token = flat.groupBy(*keys, "event_token_ids").agg(
        F.count("*").alias("n"),
        F.sum("session_flags").alias("flags"),
        F.sum("time_gap_ids").alias("g"),
        F.sum(F.col("time_gap_ids") * F.col("time_gap_ids")).alias("gg"),
        F.max("time_gap_ids").alias("gmax"),
    )
    n = F.sum("n")
    mean = F.sum("g") / n
    agg = by_token.groupBy(*keys).agg(
        F.count("*").alias("unique_event_count"),
        (F.ln(n) - F.sum(F.col("n") * F.ln("n")) / n).alias("event_entropy"),
        (n - F.count("*")).alias("repeat_count"),
        ((n - F.count("*")) / n).alias("repeat_rate"),
        F.sum("flags").alias("session_boundary_count"),
        mean.alias("gap_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum("gg") / n - mean * mean)).alias("gap_std"),
        F.max("gmax").alias("gap_max"),
    )
    return agg


def last_k(df: DataFrame, k: int = 5) -> DataFrame:
    cols = [F.coalesce(F.try_element_at("event_token_ids", F.lit(-i)), F.lit(-1)).alias(f"last_event_{i}") for i in range(1, k + 1)]
    return df.select("*", *cols)


def hashed_terms(df: DataFrame, k: int = 5) -> DataFrame:
    """``df`` with its term array: every token, every pair of neighbours, and the last k tokens with their place."""
    ids = F.transform("event_token_ids", lambda x: x.cast("string"))
    n = F.size("event_token_ids")
    uni = F.transform(ids, lambda x: F.concat(F.lit("u="), x))
    pairs = F.zip_with(F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ids, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(F.lit("b="), a, F.lit("_"), b))
    last = F.array_compact(F.array(*[F.concat(F.lit(f"last{i}="), F.try_element_at("event_token_ids", F.lit(-i)).cast("string")) for i in range(1, k + 1)]))
    return df.withColumn("terms", F.concat(uni, pairs, last))


def dense_features(frame: DataFrame, stats: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Keys, all labels, sequence features, last tokens and transition features."""
    df = markov_features(last_k(frame, k), stats).join(sequence_features(frame, keys), keys)
    return df.drop("event_token_ids", "time_gap_ids", "session_flags")


def stacked_cells(df: DataFrame, keys: list[str], width: int = 262_144, dense: tuple[str, ...] = ()) -> DataFrame:
    """Keys with ``idx`` and ``val``: the cells of a row's hashed terms, one entry a term, and behind them its dense columns."""
    hashed = F.transform("terms", lambda t: F.pmod(F.hash(t), F.lit(width)))
    tail = F.array(*[F.lit(width + i) for i in range(len(dense))]).cast("array<int>")
    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in dense]).cast("array<double>")
    ones = F.array_repeat(F.lit(1.0), F.size("terms"))
    return df.select(*keys, F.concat(hashed, tail).alias("idx"), F.concat(ones, numbers).alias("val"))


def to_vector(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(column, lambda x: x.cast("double"))))
