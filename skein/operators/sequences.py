"""Ordered events of users: prefixes, history windows, gaps and session flags.

Everything stays in long form, one row an event, until rows are cut to the wanted length; arrays are
collected last, so that a user with very many events never becomes one long array, nor one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.timing import time_gap_id
from ..sources.scratch import staged
from .ranged import edges, ranged, sums_before


#: Events of one user from which they are ordered in ranges of time instead of in one task.
MOST_EVENTS = 1_000_000


def _order() -> list[str | Column]:
    return ["event_timestamp", F.asc_nulls_last("session_id"), "event_token_id"]


def in_order() -> WindowSpec:
    """Events of a user by time, session (text order, nulls last) and token."""
    return Window.partitionBy("user_id").orderBy(*_order())


def ordered(events: DataFrame, most: int | None = None) -> DataFrame:
    """Events with rn, the user's event count, next token, gap to and session change from the event before.

    Users of more than ``most`` events are cut into ranges of time (``_ordered_in_ranges``), with the same results.
    """
    events = staged(events, "events")
    crowded = events.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > (most or MOST_EVENTS)).select("user_id")
    if crowded.isEmpty():
        return _ordered_by_user(events)
    crowded = staged(crowded, "crowded")
    light, heavy = (events.join(crowded, "user_id", how) for how in ("left_anti", "left_semi"))
    return _ordered_by_user(light).unionByName(_ordered_in_ranges(heavy))


def _ordered_by_user(events: DataFrame) -> DataFrame:
    session, order = F.coalesce("session_id", F.lit("None")), in_order()
    return events.select(
        "*",
        F.row_number().over(order).alias("rn"),
        F.count("*").over(Window.partitionBy("user_id")).alias("num_events_total"),
        F.lead("event_token_id").over(order).alias("next_token"),
        (F.col("event_timestamp") - F.lag("event_timestamp").over(order)).alias("gap"),
        (session != F.lag(session).over(order)).cast("int").alias("session_change"),
    )


def _ordered_in_ranges(events: DataFrame) -> DataFrame:
    """The same by windows over (range, user).

    What an event at the edge of its range needs is carried over: how many events of the user come before the
    range, the last of them with its session, and the first token after the range.  Only the first and the last
    user of a range have events in others, so at most two rows a range are broadcast.
    """
    rows = ranged(events, "user_id", *_order()).withColumn("__session", F.coalesce("session_id", F.lit("None")))
    last, first = F.max_by(F.struct("event_timestamp", "__session"), "__at"), F.min_by("event_token_id", "__at")
    parts = staged(edges(rows, ["user_id"], {"__n": F.count("*"), "__tail": last, "__head": first}), "edges")
    user = Window.partitionBy("__key").orderBy("__range")
    carried = parts.select(
        "__range", "__key", F.sum("__n").over(Window.partitionBy("__key")).alias("__all"), F.lag("__tail").over(user).alias("__before"), F.lead("__head").over(user).alias("__after")
    )
    carried = carried.join(sums_before(parts.select("__range", "__key", "__n"), ["__n"]), ["__range", "__key"])
    carried = carried.select("__range", F.col("__key.user_id").alias("user_id"), "__n", "__all", "__before", "__after")
    inside = Window.partitionBy("__range", "user_id").orderBy("__at")
    near = rows.select(
        "*",
        F.row_number().over(inside).alias("__rn"),
        F.count("*").over(Window.partitionBy("__range", "user_id")).alias("__here"),
        F.lead("event_token_id").over(inside).alias("__next"),
        F.lag(F.struct("event_timestamp", "__session")).over(inside).alias("__previous"),
    )
    joined = near.join(F.broadcast(carried), ["__range", "user_id"], "left")
    previous = F.coalesce("__previous", "__before")
    return joined.select(
        *events.columns,
        (F.col("__rn") + F.coalesce("__n", F.lit(0))).cast("int").alias("rn"),
        F.coalesce("__all", "__here").alias("num_events_total"),
        F.when(F.col("__rn") == F.col("__here"), F.col("__after")).otherwise(F.col("__next")).alias("next_token"),
        (F.col("event_timestamp") - previous["event_timestamp"]).alias("gap"),
        (F.col("__session") != previous["__session"]).cast("int").alias("session_change"),
    )


def users(events: DataFrame) -> DataFrame:
    """One row a user: events, first and last time."""
    return events.groupBy("user_id").agg(
        F.count("*").alias("num_events"), F.min("event_timestamp").alias("first_event_ts"), F.max("event_timestamp").alias("last_event_ts")
    )


def gap_at(start: Column) -> Column:
    """Gap bucket in a window that starts at row number ``start``: 0 at its first event."""
    return F.when(F.col("rn") == start, 0).otherwise(time_gap_id(F.col("gap"))).cast("int")


def flag_at(start: Column) -> Column:
    return F.when(F.col("rn") == start, 1).otherwise(F.coalesce("session_change", F.lit(0))).cast("int")


def _collected(rows: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
    item = F.struct("rn", "event_token_id", "gap_id", "flag")
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("s"), *extra)
    part = lambda c: F.transform("s", lambda x: x[c])
    return grouped.select(
        "*", part("event_token_id").alias("event_token_ids"), part("gap_id").alias("time_gap_ids"), part("flag").alias("session_flags")
    ).drop("s")


def prefix_rows(seq: DataFrame, lengths: list[int]) -> DataFrame:
    """Long form: the first L events of each user that has at least L, for every L."""
    lens = F.explode(F.array(*[F.lit(int(n)) for n in lengths]))
    rows = seq.filter(F.col("rn") <= max(lengths)).withColumn("prefix_len", lens)
    rows = rows.filter((F.col("rn") <= F.col("prefix_len")) & (F.col("num_events_total") >= F.col("prefix_len")))
    return rows.withColumn("gap_id", gap_at(F.lit(1))).withColumn("flag", flag_at(F.lit(1)))


def prefixes(seq: DataFrame, lengths: list[int]) -> DataFrame:
    at_end = F.col("rn") == F.col("prefix_len")
    return _collected(
        prefix_rows(seq, lengths),
        ["user_id", "prefix_len"],
        [
            F.max("num_events_total").alias("num_events_total"),
            F.min("event_timestamp").alias("prefix_start_ts"),
            F.max("event_timestamp").alias("prefix_end_ts"),
            F.max(F.when(at_end, F.col("next_token"))).alias("next_event_token_id"),
        ],
    )


def history_rows(seq: DataFrame, n: int, min_events: int, kind: str) -> DataFrame:
    """Long form of the last n events: all of them (``eval``), or those before the final one (``train``)."""
    rows = seq.filter(F.col("num_events_total") >= min_events)
    last = F.col("num_events_total") if kind == "eval" else F.greatest(F.lit(1), F.col("num_events_total") - 1)
    rows = rows.withColumn("stop", last).withColumn("start", F.greatest(F.lit(1), F.col("stop") - n + 1))
    rows = rows.filter(F.col("rn").between(F.col("start"), F.col("stop")))
    return rows.withColumn("gap_id", gap_at(F.col("start"))).withColumn("flag", flag_at(F.col("start")))


def history_windows(seq: DataFrame, n: int, min_events: int, kind: str) -> DataFrame:
    """Window arrays by user; the target is the user's final event.  ``eval`` windows hold it, ``train`` ones do not."""
    final = seq.filter(F.col("rn") == F.col("num_events_total")).select("user_id", F.col("event_token_id").alias("next_event_token_id"))
    out = _collected(
        history_rows(seq, n, min_events, kind),
        ["user_id"],
        [
            F.max("num_events_total").alias("num_events_total"),
            F.min("event_timestamp").alias("prefix_start_ts"),
            F.max("event_timestamp").alias("prefix_end_ts"),
            F.count("*").alias("window_len"),
        ],
    )
    return out.withColumn("prefix_len", F.lit(n)).join(final, "user_id")


def first_users(df: DataFrame, n: int) -> DataFrame:
    """All rows of the first n users in order of their id."""
    some = df.select("user_id").distinct().orderBy("user_id").limit(n)
    return df.join(F.broadcast(some), "user_id", "left_semi")
