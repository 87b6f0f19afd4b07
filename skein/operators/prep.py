"""Training rows: model inputs, masking, augmented views, pooled embeddings and batch inference.

Draws are uniforms from a hash of seed, row and position, so that a rerun repeats them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAD, UNK, MASK, CLS = 0, 1, 2, 3
IGNORED = -100


def uniform(seed: str, *parts: Column) -> Column:
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(2**52)


def model_inputs(df: DataFrame, length: int) -> DataFrame:
    """A leading CLS, then events, cut from the head to ``length`` and padded; with gaps, flags and attention mask."""
    def row(first: int, column: str, pad: int) -> Column:
        values = F.slice(F.concat(F.array(F.lit(first).cast("long")), F.transform(column, lambda x: x.cast("long"))), 1, length)
        return F.concat(values, F.array_repeat(F.lit(pad).cast("long"), F.lit(length) - F.size(values)))

    filled = F.least(F.lit(length), F.size("event_token_ids") + 1)
    return df.select(
        *[c for c in df.columns if c not in ("event_token_ids", "time_gap_ids", "session_flags")],
        row(CLS, "event_token_ids", PAD).alias("input_ids"),
        row(0, "time_gap_ids", 0).alias("time_gap_ids"),
        F.transform(row(1, "session_flags", 0), lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(1))).alias("session_flags"),
        F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (i < filled).cast("int")).alias("attention_mask"),
    )


def mask_tokens(inputs: DataFrame, key: str, vocab_size: int, rate: float = 0.15, mask_share: float = 0.8, random_share: float = 0.1, seed: str = "42") -> DataFrame:
    """Long form (key, pos, token, masked_token, label): chosen positions are masked, drawn anew or kept.

    Each row with an event has at least one chosen position: the one with the smallest draw.
    """
    long = inputs.select(key, F.posexplode("input_ids").alias("pos", "token"))
    draw = lambda kind: uniform(f"{seed}{kind}", F.col(key), F.col("pos"))
    free = ~F.col("token").isin(PAD, CLS, MASK)
    long = long.withColumn("free", free).withColumn("u", draw("m"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("free"), "u", "pos"))
    long = long.withColumn("chosen", F.col("free") & ((F.col("u") < rate) | (first == 1)))
    fresh = (F.floor(draw("t") * (vocab_size - 4)) + 4).cast("long")
    replaced = F.when(draw("k") < mask_share, F.lit(MASK).cast("long")).when(draw("r") < random_share, fresh).otherwise(F.col("token"))
    return long.select(
        key, "pos", "token", F.when(F.col("chosen"), replaced).otherwise(F.col("token")).alias("masked_token"), F.when(F.col("chosen"), F.col("token")).otherwise(F.lit(IGNORED)).alias("label")
    )


def augmented_view(df: DataFrame, key: str, rates: dict[str, float], seed: str) -> DataFrame:
    """One view of each sequence: masked, cropped or reordered, chosen in proportion to the rates.

    Counts are rounded half to even; a crop keeps a contiguous part, a reorder permutes one, and gaps
    and flags move with their events.
    """
    kinds = [(k, r) for k, r in rates.items() if r > 0]
    if not kinds:
        return df
    total, upto, kind = sum(r for _, r in kinds), 0.0, F.lit(None).cast("string")
    u = uniform(f"{seed}op", F.col(key))
    for name, rate in reversed(kinds):
        kind = F.when(u >= 1 - (upto + rate) / total, name) if upto == 0 else F.when(u < 1 - upto / total, F.when(u >= 1 - (upto + rate) / total, name)).otherwise(kind)
        upto += rate
    n = F.size("event_token_ids")
    items = F.arrays_zip("event_token_ids", "time_gap_ids", "session_flags")
    df = df.withColumn("__kind", F.when(n > 0, kind)).withColumn("__items", items).withColumn("__n", n)
    rate_of = lambda k, most=1.0: F.lit(min(most, max(0.0, float(rates.get(k, 0.0)))))
    part = F.when(F.col("__kind") == "crop", F.greatest(F.lit(1), F.rint(F.col("__n") * (1 - rate_of("crop", 0.95))).cast("int")))
    part = part.when(F.col("__kind") == "reorder", F.greatest(F.lit(2), F.rint(F.col("__n") * rate_of("reorder")).cast("int")))
    part = part.otherwise(F.greatest(F.lit(1), F.rint(F.col("__n") * rate_of("mask")).cast("int")))
    df = df.withColumn("__part", F.least("__n", part)).withColumn("__start", F.floor(uniform(f"{seed}start", F.col(key)) * (F.col("__n") - F.col("__part") + 1)).cast("int"))
    shuffled = lambda arr: F.transform(F.array_sort(F.transform(arr, lambda x, i: F.struct(uniform(f"{seed}p", F.col(key), i).alias("u"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    span = F.slice("__items", F.col("__start") + 1, F.col("__part"))
    reordered = F.concat(F.slice("__items", F.lit(1), F.col("__start")), shuffled(span), F.slice("__items", F.col("__start") + F.col("__part") + 1, F.col("__n")))
    chosen = F.slice(shuffled(F.sequence(F.lit(0), F.col("__n") - 1)), F.lit(1), F.col("__part"))
    swap = lambda x, i: F.struct(F.when(F.array_contains(chosen, i), F.lit(MASK).cast("long")).otherwise(x["event_token_ids"]).alias("event_token_ids"), x["time_gap_ids"].alias("time_gap_ids"), x["session_flags"].alias("session_flags"))
    typed = df.schema["event_token_ids"].dataType.elementType.simpleString()
    same = f"array<struct<event_token_ids:{typed},time_gap_ids:{df.schema['time_gap_ids'].dataType.elementType.simpleString()},session_flags:{df.schema['session_flags'].dataType.elementType.simpleString()}>>"
    view = F.when(F.col("__kind") == "crop", span.cast(same)).when((F.col("__kind") == "reorder") & (F.col("__n") >= 2), reordered.cast(same))
    view = view.when(F.col("__kind") == "mask", F.transform("__items", swap).cast(same)).otherwise(F.col("__items").cast(same))
    df = df.withColumn("__view", view)
    keep = [c for c in df.columns if not c.startswith("__") and c not in ("event_token_ids", "time_gap_ids", "session_flags")]
    return df.select(*keep, F.col("__kind").alias("view_kind"), *[F.col(f"__view.{c}").alias(c) for c in ("event_token_ids", "time_gap_ids", "session_flags")])


def token_vectors(train: DataFrame, size: int = 16, seed: int = 42) -> DataFrame:
    """(token, vector) learned from the token sequences."""
    words = train.select(F.transform("event_token_ids", lambda x: x.cast("string")).alias("words"))
    model = Word2Vec(vectorSize=size, minCount=1, seed=seed, inputCol="words", outputCol="v").fit(words)
    return model.getVectors().select(F.col("word").cast("long").alias("token"), vector_to_array("vector").alias("vector"))


def pool_states(states: DataFrame, keys: list[str], pooling: str = "mean") -> DataFrame:
    """(keys, embedding) from rows of keys, ``pos`` and ``vector``: place 0 is the leading CLS, events follow.

    ``cls`` is the vector at place 0, ``mean`` that of the events (CLS if there are none), ``last`` the one
    at the largest place; several joined by ``+`` stand one after the other.
    """
    names = pooling.split("+")
    if not set(names) <= {"cls", "mean", "last"}:
        raise ValueError(f"unknown pooling: {pooling}")
    dims = states.select(*keys, "pos", F.posexplode("vector").alias("dim", "x"))
    cls = F.max(F.when(F.col("pos") == 0, F.col("x")))
    per = dims.groupBy(*keys, "dim").agg(cls.alias("cls"), F.coalesce(F.avg(F.when(F.col("pos") > 0, F.col("x"))), cls).alias("mean"), F.max_by("x", "pos").alias("last"))
    rows = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "cls", "mean", "last"))).alias("s"))
    part = {"cls": F.transform("s", lambda x: x["cls"]), "mean": F.transform("s", lambda x: x["mean"]), "last": F.transform("s", lambda x: x["last"])}
    return rows.select(*keys, F.concat(*[part[c] for c in names]).alias("embedding"))


def pooled(df: DataFrame, keys: str | list[str], vectors: DataFrame, pooling: str = "mean") -> DataFrame:
    """(keys, embedding): the token vectors of each sequence behind that of CLS, pooled.

    A token without a vector has that of UNK, or zeros if UNK has none; so has CLS, and a key without tokens.
    """
    keys = [keys] if isinstance(keys, str) else keys
    with_cls = F.concat(F.array(F.lit(CLS).cast("long")), F.transform(F.coalesce("event_token_ids", F.array()), lambda x: x.cast("long")))
    long = df.select(*keys, F.posexplode(with_cls).alias("pos", "token"))
    width = vectors.agg(F.max(F.size("vector")).alias("n"), F.max(F.when(F.col("token") == UNK, F.col("vector"))).alias("unk"))
    other = width.select(F.coalesce("unk", F.array_repeat(F.lit(0.0), F.coalesce("n", F.lit(0)))).alias("other"))
    known = long.join(vectors, "token", "left").crossJoin(F.broadcast(other))
    return pool_states(known.select(*keys, "pos", F.coalesce("vector", "other").alias("vector")), keys, pooling)


def predict(df: DataFrame, make_model: Callable, inputs: list[str], out: str, shapes: list[list[int]] | None = None, batch: int = 1024) -> DataFrame:
    """A user-given model over Arrow batches on the executors."""
    udf = predict_batch_udf(make_model, return_type=T.DoubleType(), batch_size=batch, input_tensor_shapes=shapes)
    return df.withColumn(out, udf(*inputs))
