"""Shared inputs of the queries, as DataFrames and as the same steps in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import hash_split
from ..operators import labels, normalize, sequences, vocab
from ..sources import tables
from ..sources.scratch import staged

LENGTHS, DAYS, SPANS, LAST_N, MIN_EVENTS = [10, 20, 50], [7, 14, 30], [7, 14, 28, 29], 32, 10
PREFIX_KEYS = ["user_id", "prefix_len"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the common tables of ``COMMON`` by starting with a select."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def common(select: str) -> str:
    return COMMON + select


def normalized(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalize_events(tables.events(spark, d))


def signed(spark: SparkSession, d: str) -> DataFrame:
    return normalize.with_signatures(tables.events(spark, d))


def event_vocab(events: DataFrame) -> DataFrame:
    return vocab.build_vocab(vocab.frequencies(events, "event_signature"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Events with their token id."""
    events = signed(spark, d).select("user_id", "event_timestamp", "session_id", "event_signature")
    return vocab.encode_tokens(events, event_vocab(events), "event_signature")


def sequence(spark: SparkSession, d: str) -> DataFrame:
    return sequences.ordered(tokens(spark, d))


def prefixes(spark: SparkSession, d: str, lengths: list[int] = LENGTHS) -> DataFrame:
    """Prefix arrays with split and retention labels."""
    seq = sequence(spark, d)
    out = sequences.prefixes(seq, lengths).join(labels.prefix_labels(seq, lengths, DAYS), PREFIX_KEYS)
    return out.withColumn("split", hash_split(F.col("user_id")))


def kept_prefixes(spark: SparkSession, d: str, lengths: list[int] = LENGTHS) -> DataFrame:
    """The prefix table, written once for queries that read it in several steps."""
    return staged(prefixes(spark, d, lengths), "prefixes")


def text(c: str):
    """An array as text, for results that other engines can compare."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)


COMMON = """
WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS event_name, coalesce(props, '{}') AS event_json,
  CAST(floor(epoch(ts)) AS BIGINT) AS event_timestamp, CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id FROM events),
tok AS (SELECT *, 'event=' || trim(event_name) AS event_token, 'event=' || trim(event_name) || '|json=' ||
  CASE WHEN len(json_keys(event_json)) = 0 THEN '__empty__' ELSE array_to_string(list_sort(json_keys(event_json)), '+') END AS event_signature FROM ev),
freq AS (SELECT event_signature AS token, count(*) AS count FROM tok GROUP BY 1),
voc AS (SELECT token, 3 + row_number() OVER (ORDER BY count DESC, token) AS id FROM freq WHERE count >= 2
  UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[MASK]', 2), ('[CLS]', 3))),
sq AS (SELECT tok.*, CAST(coalesce(voc.id, 1) AS BIGINT) AS event_token_id FROM tok LEFT JOIN voc ON tok.event_signature = voc.token),
o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS num_events_total, lead(event_token_id) OVER w AS next_token,
  event_timestamp - lag(event_timestamp) OVER w AS gap, CASE WHEN session_id <> lag(session_id) OVER w THEN 1 ELSE 0 END AS session_change
  FROM sq WINDOW w AS (PARTITION BY user_id ORDER BY event_timestamp, session_id NULLS LAST, event_token_id)),
us AS (SELECT user_id, CAST(concat('0x', substr(sha256('42:' || user_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS share,
  count(*) AS num_events, min(event_timestamp) AS first_event_ts, max(event_timestamp) AS last_event_ts FROM sq GROUP BY user_id),
usr AS (SELECT *, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.7::DOUBLE + 0.15::DOUBLE THEN 'valid' ELSE 'test' END AS split FROM us),
lens AS (SELECT CAST(unnest([10, 20, 50]) AS INTEGER) AS prefix_len),
pl AS (SELECT o.*, prefix_len, CASE WHEN rn = 1 THEN 0 WHEN gap <= 0 THEN 0 WHEN gap <= 1 THEN 1 WHEN gap <= 10 THEN 2 WHEN gap <= 60 THEN 3 WHEN gap <= 300 THEN 4
  WHEN gap <= 3600 THEN 5 WHEN gap <= 21600 THEN 6 WHEN gap <= 86400 THEN 7 WHEN gap <= 604800 THEN 8 ELSE 9 END AS gap_id,
  CASE WHEN rn = 1 THEN 1 ELSE session_change END AS flag FROM o JOIN lens ON rn <= prefix_len AND num_events_total >= prefix_len),
px AS (SELECT pl.user_id, prefix_len, any_value(split) AS split, max(num_events_total) AS num_events_total, min(event_timestamp) AS prefix_start_ts, max(event_timestamp) AS prefix_end_ts,
  max(CASE WHEN rn = prefix_len THEN next_token END) AS next_event_token_id, max(CASE WHEN rn = prefix_len THEN event_token_id END) AS last_event_token_id,
  list(event_token_id ORDER BY rn) AS ids, list(gap_id ORDER BY rn) AS gaps, list(flag ORDER BY rn) AS flags FROM pl JOIN usr ON pl.user_id = usr.user_id GROUP BY ALL),
mx AS (SELECT max(event_timestamp) AS m FROM sq),
lab AS (SELECT px.*, x.d, m >= prefix_end_ts + (x.d + 1) * 86400 AS available, EXISTS (SELECT 1 FROM sq WHERE sq.user_id = px.user_id
  AND sq.event_timestamp >= prefix_end_ts + x.d * 86400 AND sq.event_timestamp < prefix_end_ts + (x.d + 1) * 86400) AS seen
  FROM px, mx, (SELECT unnest([7, 14, 30]) AS d) x),
tr AS (SELECT last_event_token_id AS l, next_event_token_id AS n, count(*) AS c FROM px WHERE split = 'train' AND next_event_token_id IS NOT NULL GROUP BY 1, 2),
mk AS (SELECT * FROM (SELECT l, n, c, sum(c) OVER (PARTITION BY l) AS total, row_number() OVER (PARTITION BY l ORDER BY c DESC, n) AS rank FROM tr) WHERE rank <= 10),
pop AS (SELECT next_event_token_id AS n, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, next_event_token_id) AS rank FROM px
  WHERE split = 'train' AND next_event_token_id IS NOT NULL GROUP BY 1 QUALIFY rank <= 10)
"""
