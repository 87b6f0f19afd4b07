"""Queries on event tables: scans, filters, vocabularies, sequences, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.timing import GAP_BOUNDS, epoch_seconds, hash_share, hash_split, rounded_long, time_gap_id
from ..operators import labels, normalize, ranged, sequences, splits, vocab
from ..sources import files, tables
from ..sources.scratch import scratch_path
from .base import DAYS, LAST_N, LENGTHS, MIN_EVENTS, SPANS, common, event_vocab, normalized, prefixes, query, sequence, signed, text, tokens


# ---- scans and sources


@query("q_s4_scan_columns", "SELECT event_id, event_type FROM events WHERE value > 50")
def s4(spark, d):
    return tables.table(spark, d, "events", ["event_id", "event_type", "value"]).filter("value > 50").drop("value")


@query("q_s5_first_users", common("SELECT user_id, event_timestamp, event_name FROM ev WHERE user_id IN (SELECT DISTINCT user_id FROM ev ORDER BY user_id LIMIT 5)"))
def s5(spark, d):
    return sequences.first_users(tables.events(spark, d), 5).select("user_id", "event_timestamp", "event_name")


@query(
    "q_s7_split_map",
    """WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, lower(trim(CASE c_custkey % 6 WHEN 0 THEN ' TRN' WHEN 1 THEN 'Val ' WHEN 2 THEN 'validation' WHEN 3 THEN 'tst' WHEN 4 THEN 'train' ELSE 'dev' END)) AS s FROM customer)
    SELECT user_id, CASE s WHEN 'trn' THEN 'train' WHEN 'val' THEN 'valid' WHEN 'validation' THEN 'valid' WHEN 'tst' THEN 'test' ELSE s END AS split FROM r WHERE s <> 'dev'""",
)
def s7(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" TRN", "Val ", "validation", "tst", "train", "dev")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return files.clean_split_map(tables.table(spark, d, "customer").select("c_custkey", raw.alias("s")), "c_custkey", "s")


@query("q_s8_frequency_table", common("SELECT token, count FROM freq"))
def s8(spark, d):
    return vocab.frequencies(signed(spark, d), "event_signature")


@query("q_s10_sorted_export", common("SELECT user_id, event_timestamp, session_id, event_token_id FROM sq"))
def s10(spark, d):
    return files.sorted_export(tokens(spark, d)).select("user_id", "event_timestamp", "session_id", "event_token_id")


@query("q_s12_audit", "SELECT count(*) AS rows_in, count(*) FILTER (value IS NOT NULL AND user_id IS NOT NULL AND value < 90) AS rows_out, count(*) - count(*) FILTER (value IS NOT NULL AND user_id IS NOT NULL AND value < 90) AS rows_dropped FROM events")
def s12(spark, d):
    raw = tables.table(spark, d, "events", ["user_id", "value"])
    return files.ingest_audit(raw, raw.na.drop().filter("value < 90"))


RAW = {"user_id": "device", "event_name": "name", "event_json": "payload", "event_datetime": "moment", "event_timestamp": "seconds", "session_id": "visit"}
_RAW = """WITH r AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS device, ' ' || event_type || ' ' AS name, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS payload,
  CASE WHEN event_id % 13 = 0 THEN 'no time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment, CASE WHEN event_id % 17 = 0 THEN 'soon' ELSE CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) END AS seconds,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS visit FROM events) """


def _raw_csv(spark, d):
    """The events as a raw CSV, written and read again: quoted payloads, missing users, texts that are no times."""
    path, rows = scratch_path(spark, "raw"), tables.table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    every = lambda n, other, value: F.when(F.col("event_id") % n == 0, F.lit(other).cast("string")).otherwise(value)
    raw = rows.select(
        F.col("event_id").cast("string").alias("event_id"),
        every(11, "NULL", F.col("user_id").cast("string")).alias("device"),
        F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("name"),
        every(5, "", F.col("props")).alias("payload"),
        every(13, "no time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("moment"),
        every(17, "soon", epoch_seconds(F.col("ts")).cast("string")).alias("seconds"),
        every(3, "None", F.to_date("ts").cast("string")).alias("visit"),
    )
    raw.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_raw_csv(spark, path, ["event_id", *RAW.values()])


@query("q_s1_raw_csv", _RAW + "SELECT CAST(event_id AS VARCHAR) AS event_id, device, name, payload, moment, seconds, visit FROM r")
def s1(spark, d):
    return _raw_csv(spark, d)


@query("q_s2_required_columns", _RAW + "SELECT device, seconds FROM r")
def s2(spark, d):
    return files.require_columns(_raw_csv(spark, d), ["device", "seconds"])


_CLEAN = _RAW + "SELECT {columns} FROM r WHERE device IS NOT NULL AND moment <> 'no time' AND seconds <> 'soon'"


@query("q_p2_coerced", _CLEAN.format(columns="device AS user_id, trim(name) AS event_name, coalesce(payload, '{}') AS event_json, CAST(seconds AS BIGINT) AS event_timestamp"))
def p2(spark, d):
    return files.clean_events(_raw_csv(spark, d), RAW).select("user_id", "event_name", "event_json", "event_timestamp")


@query("q_p3_unparsed_times", _CLEAN.format(columns="device AS user_id, CAST(moment AS TIMESTAMP) AS event_datetime, CAST(seconds AS BIGINT) AS event_timestamp"))
def p3(spark, d):
    return files.clean_events(_raw_csv(spark, d), RAW).select("user_id", "event_datetime", "event_timestamp")


@query("q_p4_canonical_names", _CLEAN.format(columns="device AS user_id, trim(name) AS event_name, visit AS session_id"))
def p4(spark, d):
    return files.clean_events(_raw_csv(spark, d), RAW).select("user_id", "event_name", "session_id")


# ---- filters and projections


@query("q_p1_drop_nulls", "SELECT event_id, nullif(user_id % 7, 0) AS k FROM events WHERE user_id % 7 <> 0")
def p1(spark, d):
    return tables.table(spark, d, "events", ["event_id", "user_id"]).selectExpr("event_id", "nullif(user_id % 7, 0) AS k").na.drop(subset=["k"])


@query("q_p5_event_token", common("SELECT user_id, event_timestamp, event_token FROM tok"))
def p5(spark, d):
    return tables.events(spark, d).select("user_id", "event_timestamp", normalize.event_token(F.col("event_name")).alias("event_token"))


@query("q_p6_event_signature", common("SELECT user_id, event_timestamp, event_signature FROM tok"))
def p6(spark, d):
    return normalized(spark, d).select("user_id", "event_timestamp", "event_signature")


@query("q_p7_unknown_tokens", """WITH f AS (SELECT props AS token, count(*) AS count FROM events GROUP BY 1),
  v AS (SELECT token, 3 + row_number() OVER (ORDER BY count DESC, token) AS id FROM (SELECT * FROM f WHERE count >= 2 ORDER BY count DESC, token LIMIT 46))
  SELECT event_id, CAST(coalesce(v.id, 1) AS BIGINT) AS token_id FROM events LEFT JOIN v ON props = token""")  # fmt: skip
def p7(spark, d):
    events = tables.table(spark, d, "events", ["event_id", "props"])
    small = vocab.build_vocab(vocab.frequencies(events, "props"), max_size=50)
    return vocab.encode_tokens(events, small, "props", "token_id").select("event_id", "token_id")


@query("q_p8_metadata_columns", common("SELECT user_id, prefix_len, split, num_events_total, prefix_start_ts, prefix_end_ts, next_event_token_id, available AS label_available_retention_14d, CASE WHEN available THEN CAST(seen AS INTEGER) END AS label_retention_14d FROM lab WHERE d = 14"))
def p8(spark, d):
    rows = prefixes(spark, d)
    return labels.metadata_columns(labels.drop_labels(rows, ("label_available_retention_14d", "label_retention_14d")))


@query("q_p14_new_labels", common("SELECT px.user_id, prefix_len, CAST(last_event_ts - first_event_ts >= 7 * 86400 AS INTEGER) AS label_retention_7d FROM px JOIN usr ON px.user_id = usr.user_id"))
def p14(spark, d):
    rows, seq = prefixes(spark, d), sequence(spark, d)
    fresh = labels.duration_labels(sequences.users(seq), [7]).select("user_id", "label_retention_7d")
    return labels.join_many_to_one(labels.drop_labels(rows), fresh, ["user_id"]).select("user_id", "prefix_len", "label_retention_7d")


@query("q_p10_eligible_rows", common("SELECT user_id, prefix_len FROM lab WHERE d = 7 AND available AND prefix_len = 20 AND split = 'train'"))
def p10(spark, d):
    from ..operators.probes import eligible

    return eligible(prefixes(spark, d), "retention_7d", 20, "train").select("user_id", "prefix_len")


@query("q_p11_has_next", common("SELECT user_id, prefix_len, next_event_token_id FROM px WHERE next_event_token_id IS NOT NULL"))
def p11(spark, d):
    return prefixes(spark, d).filter(F.col("next_event_token_id").isNotNull()).select("user_id", "prefix_len", "next_event_token_id")


@query("q_p12_long_users", common("SELECT user_id, num_events FROM usr WHERE num_events >= 60"))
def p12(spark, d):
    return sequences.users(tables.events(spark, d)).filter("num_events >= 60").select("user_id", "num_events")


# ---- joins


@query("q_j1_vocab_join", common("SELECT user_id, event_timestamp, event_signature, event_token_id FROM sq"))
def j1(spark, d):
    return tokens(spark, d).select("user_id", "event_timestamp", "event_signature", "event_token_id")


_MAP = "SELECT user_id, CASE CAST(user_id AS BIGINT) % 3 WHEN 0 THEN 'train' ELSE 'test' END AS split FROM usr WHERE CAST(user_id AS BIGINT) % 2 = 0"


def _split_map(users):
    number = F.col("user_id").cast("long")
    return users.filter(number % 2 == 0).select("user_id", F.when(number % 3 == 0, "train").otherwise("test").alias("split"))


@query("q_j2_split_lookup", common(f"SELECT usr.user_id, coalesce(m.split, usr.split) AS split FROM usr LEFT JOIN ({_MAP}) m ON usr.user_id = m.user_id"))
def j2(spark, d):
    users = sequences.users(tables.events(spark, d))
    return splits.assign_splits(users, _split_map(users), "hash").select("user_id", "split")


@query("q_j3_parse_once", common("SELECT user_id, event_timestamp, array_to_string(list_sort(json_keys(event_json)), '+') AS keys FROM ev"))
def j3(spark, d):
    return normalized(spark, d).select("user_id", "event_timestamp", F.array_join("json_top_keys", "+").alias("keys"))


@query("q_j4_label_join", common("SELECT px.user_id, prefix_len, CAST(last_event_ts - first_event_ts >= 28 * 86400 AS INTEGER) AS label_retention_28d FROM px JOIN usr ON px.user_id = usr.user_id"))
def j4(spark, d):
    seq = sequence(spark, d)
    lookup = labels.duration_labels(sequences.users(seq), [28]).select("user_id", "label_retention_28d")
    frame = labels.drop_labels(sequences.prefixes(seq, LENGTHS)).select("user_id", "prefix_len")
    return labels.join_many_to_one(frame, lookup, ["user_id"])


@query("q_j8_event_in_window", common("""SELECT user_id, event_timestamp, EXISTS (SELECT 1 FROM sq b WHERE b.user_id = sq.user_id AND b.event_timestamp >= sq.event_timestamp + 7 * 86400
  AND b.event_timestamp < sq.event_timestamp + 8 * 86400) AS seen FROM sq"""))  # fmt: skip
def j8(spark, d):
    by_time = Window.partitionBy("user_id").orderBy("event_timestamp")
    seen = F.count("*").over(by_time.rangeBetween(7 * 86400, 8 * 86400 - 1)) > 0
    return tables.events(spark, d).select("user_id", "event_timestamp", seen.alias("seen"))


# ---- aggregates


@query("q_a1_token_frequencies", """SELECT token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS token FROM conversations) GROUP BY 1""")
def a1(spark, d):
    words = tables.table(spark, d, "conversations", ["text"]).select(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)).alias("words"))
    return vocab.frequencies(words, "words")


@query("q_a2_vocab", common("SELECT token, CAST(id AS BIGINT) AS id FROM voc"))
def a2(spark, d):
    return event_vocab(signed(spark, d))


@query("q_a2_word_vocab", """WITH f AS (SELECT token, count(*) AS c FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS token FROM conversations) GROUP BY 1 HAVING count(*) >= 2)
  SELECT token, CAST(3 + row_number() OVER (ORDER BY c DESC, token) AS BIGINT) AS id FROM f UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[MASK]', 2), ('[CLS]', 3))""")  # fmt: skip
def a2_words(spark, d):
    return vocab.build_vocab(a1(spark, d))


@query("q_a3_coverage", """WITH f AS (SELECT props AS token, count(*) AS count FROM events GROUP BY 1), k AS (SELECT * FROM f WHERE count >= 2 ORDER BY count DESC, token LIMIT 46)
  SELECT count(*) AS unique_total, CAST(count(k.token) AS BIGINT) AS unique_kept, CAST(count(*) - count(k.token) AS BIGINT) AS unique_oov, CAST(sum(f.count) AS BIGINT) AS occurrences_total,
  CAST(sum(k.count) AS BIGINT) AS occurrences_kept, CAST(sum(f.count) - sum(k.count) AS BIGINT) AS occurrences_oov, round(sum(k.count)::DOUBLE / sum(f.count), 6) AS coverage_ratio FROM f LEFT JOIN k ON f.token = k.token""")  # fmt: skip
def a3(spark, d):
    freq = vocab.frequencies(tables.table(spark, d, "events", ["props"]), "props")
    return vocab.coverage(freq, vocab.build_vocab(freq, max_size=50)).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query("q_a4_dataset_end", common("SELECT max(event_timestamp) AS dataset_max_ts FROM ev"))
def a4(spark, d):
    return tables.events(spark, d).agg(F.max("event_timestamp").alias("dataset_max_ts"))


@query("q_a5_users", common("SELECT user_id, num_events, first_event_ts, last_event_ts FROM usr"))
def a5(spark, d):
    return sequences.users(tables.events(spark, d))


@query("q_a9_split_counts", common("SELECT split, count(*) AS users, CAST(sum(num_events) AS BIGINT) AS events FROM usr GROUP BY 1"))
def a9(spark, d):
    users = splits.assign_splits(sequences.users(tables.events(spark, d)), None)
    return users.groupBy("split").agg(F.count("*").alias("users"), F.sum("num_events").alias("events"))


@query("q_a10_parse_errors", "SELECT count(*) FILTER (NOT json_valid(p)) AS parse_errors, count(*) AS rows_out FROM (SELECT CASE WHEN event_id % 11 = 0 THEN substr(props, 2) ELSE props END AS p FROM events)")
def a10(spark, d):
    damaged = tables.table(spark, d, "events").selectExpr("CASE WHEN event_id % 11 = 0 THEN substr(props, 2) ELSE props END AS event_json")
    parsed = normalize.parse_payloads(damaged.distinct())
    return normalize.parse_errors(damaged.join(parsed, "event_json"))


@query("q_a16_distinct_payloads", common("SELECT DISTINCT event_json FROM ev"))
def a16(spark, d):
    return tables.events(spark, d).select("event_json").distinct()


# ---- sequences


@query("q_w1_ordered_events", common("SELECT user_id, array_to_string(list(event_token_id ORDER BY rn), ' ') AS event_token_ids FROM o GROUP BY 1"))
def w1(spark, d):
    seq = sequence(spark, d)
    rows = seq.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "event_token_id"))).alias("s"))
    return rows.select("user_id", F.transform("s", lambda x: x["event_token_id"]).alias("event_token_ids")).select("user_id", text("event_token_ids"))


@query("q_w2_prefixes", common("""SELECT px.user_id, px.prefix_len, array_to_string(ids, ' ') AS event_token_ids, next_event_token_id, prefix_end_ts,
  available AS label_available_retention_7d, CASE WHEN available THEN CAST(seen AS INTEGER) END AS label_retention_7d FROM lab px WHERE d = 7"""))  # fmt: skip
def w2(spark, d):
    """Each user's first 10, 20 and 50 events: tokens, next token, 7-day retention."""
    rows = prefixes(spark, d)
    return rows.select("user_id", "prefix_len", text("event_token_ids"), "next_event_token_id", "prefix_end_ts", "label_available_retention_7d", "label_retention_7d")


@query("q_w2_prefix_lengths", common("SELECT user_id, prefix_len, num_events_total, prefix_start_ts, prefix_end_ts, array_to_string(ids, ' ') AS event_token_ids FROM px"))
def w2_lengths(spark, d):
    rows = sequences.prefixes(sequence(spark, d), LENGTHS)
    return rows.select("user_id", "prefix_len", "num_events_total", "prefix_start_ts", "prefix_end_ts", text("event_token_ids"))


_WINDOW = """SELECT user_id, array_to_string(list(event_token_id ORDER BY rn), ' ') AS event_token_ids, count(*) AS window_len, any_value(final) AS next_event_token_id,
  array_to_string(list(CASE WHEN rn = start THEN 0 WHEN gap <= 0 THEN 0 WHEN gap <= 1 THEN 1 WHEN gap <= 10 THEN 2 WHEN gap <= 60 THEN 3 WHEN gap <= 300 THEN 4 WHEN gap <= 3600 THEN 5
  WHEN gap <= 21600 THEN 6 WHEN gap <= 86400 THEN 7 WHEN gap <= 604800 THEN 8 ELSE 9 END ORDER BY rn), ' ') AS time_gap_ids,
  array_to_string(list(CASE WHEN rn = start THEN 1 ELSE session_change END ORDER BY rn), ' ') AS session_flags
  FROM (SELECT o.*, {stop} AS stop, greatest(1, {stop} - 31) AS start, max(CASE WHEN rn = num_events_total THEN event_token_id END) OVER (PARTITION BY user_id) AS final FROM o
  WHERE num_events_total >= 10) WHERE rn BETWEEN start AND stop GROUP BY user_id"""


def _windows(spark, d, kind):
    rows = sequences.history_windows(sequence(spark, d), LAST_N, MIN_EVENTS, kind)
    return rows.select("user_id", text("event_token_ids"), "window_len", "next_event_token_id", text("time_gap_ids"), text("session_flags"))


@query("q_w3_eval_window", common(_WINDOW.format(stop="num_events_total")))
def w3(spark, d):
    return _windows(spark, d, "eval")


@query("q_w4_train_window", common(_WINDOW.format(stop="greatest(1, num_events_total - 1)")))
def w4(spark, d):
    return _windows(spark, d, "train")


@query("q_w5_next_token", common("SELECT user_id, prefix_len, next_event_token_id FROM px"))
def w5(spark, d):
    return sequences.prefixes(sequence(spark, d), LENGTHS).select("user_id", "prefix_len", "next_event_token_id")


@query("q_w6_gap_ids", common("SELECT user_id, prefix_len, array_to_string(gaps, ' ') AS time_gap_ids FROM px"))
def w6(spark, d):
    return sequences.prefixes(sequence(spark, d), LENGTHS).select("user_id", "prefix_len", text("time_gap_ids"))


@query("q_w7_session_flags", common("SELECT user_id, prefix_len, array_to_string(flags, ' ') AS session_flags FROM px"))
def w7(spark, d):
    return sequences.prefixes(sequence(spark, d), LENGTHS).select("user_id", "prefix_len", text("session_flags"))


@query("q_w10_last_tokens", common("SELECT user_id, prefix_len, " + ", ".join(f"coalesce(ids[len(ids) - {i}], -1) AS last_event_{i + 1}" for i in range(5)) + " FROM px"))
def w10(spark, d):
    from ..operators.features import last_k

    rows = last_k(sequences.prefixes(sequence(spark, d), LENGTHS))
    return rows.select("user_id", "prefix_len", *[f"last_event_{i}" for i in range(1, 6)])


_LABELS = "SELECT user_id, prefix_len, " + ", ".join(
    f"bool_or(available) FILTER (d = {x}) AS label_available_retention_{x}d, max(CASE WHEN available THEN CAST(seen AS INTEGER) END) FILTER (d = {x}) AS label_retention_{x}d" for x in DAYS
)


@query("q_w11_retention", common(_LABELS + " FROM lab GROUP BY 1, 2"))
def w11(spark, d):
    return labels.prefix_labels(sequence(spark, d), LENGTHS, DAYS)


@query("q_w12_duration", common("SELECT user_id, " + ", ".join(f"CAST(last_event_ts - first_event_ts >= {x} * 86400 AS INTEGER) AS label_retention_{x}d" for x in SPANS) + " FROM usr"))
def w12(spark, d):
    return labels.duration_labels(sequences.users(tables.events(spark, d)), SPANS).select("user_id", *[f"label_retention_{x}d" for x in SPANS])


@query("q_w12_duration_orders", """SELECT o_custkey, CAST(floor(epoch(max(o_orderdate)) - epoch(min(o_orderdate))) >= 365 * 86400 AS INTEGER) AS label_retention_365d FROM orders GROUP BY 1""")
def w12_orders(spark, d):
    from ..functions.timing import epoch_seconds

    rows = tables.table(spark, d, "orders", ["o_custkey", "o_orderdate"]).select(F.col("o_custkey").alias("user_id"), epoch_seconds(F.col("o_orderdate")).alias("event_timestamp"))
    return labels.duration_labels(sequences.users(rows), [365]).select(F.col("user_id").alias("o_custkey"), "label_retention_365d")


# ---- sorts, sets


@query("q_t1_four_key_sort", common("SELECT user_id, event_timestamp, session_id, event_token_id, row_number() OVER (ORDER BY user_id, event_timestamp, session_id NULLS LAST, event_token_id) - 1 AS place FROM sq"))
def t1(spark, d):
    rows = tokens(spark, d).select("user_id", "event_timestamp", "session_id", "event_token_id")
    return ranged.row_numbers(rows, "place", F.asc("user_id"), F.asc("event_timestamp"), F.asc_nulls_last("session_id"), F.asc("event_token_id"))


@query("q_t3_top_tokens", "SELECT token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS token FROM conversations) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def t3(spark, d):
    return vocab.top_tokens(a1(spark, d), 20)


@query("q_u1_union_splits", common("SELECT user_id, split FROM usr WHERE split IN ('train', 'test')"))
def u1(spark, d):
    from ..operators.report import tagged_union

    users = splits.assign_splits(sequences.users(tables.events(spark, d)), None)
    return tagged_union({s: users.filter(F.col("split") == s).select("user_id") for s in ("train", "test")})


@query("q_u3_vocab_without_special", common("SELECT token FROM voc EXCEPT SELECT * FROM (VALUES ('[PAD]'), ('[UNK]'), ('[MASK]'), ('[CLS]'))"))
def u3(spark, d):
    special = spark.createDataFrame([(t,) for t in vocab.SPECIAL_TOKENS], "token string")
    return event_vocab(signed(spark, d)).select("token").join(F.broadcast(special), "token", "left_anti")


# ---- functions on columns


@query("q_x6_time_gap", "SELECT o_orderkey, CASE " + " ".join(f"WHEN g <= {b} THEN {k}" for k, b in enumerate((0, *GAP_BOUNDS))) + " ELSE 9 END AS gap_id FROM (SELECT o_orderkey, (o_orderkey * 7919) % 1000003 - 1000 AS g FROM orders)")
def x6(spark, d):
    gap = (F.col("o_orderkey") * 7919) % 1000003 - 1000
    return tables.table(spark, d, "orders", ["o_orderkey"]).select("o_orderkey", time_gap_id(gap).alias("gap_id"))


@query("q_x7_hash_split", common("SELECT user_id, share, split FROM usr"))
def x7(spark, d):
    users = tables.events(spark, d).select("user_id").distinct()
    return users.select("user_id", hash_share(F.col("user_id")).alias("share"), hash_split(F.col("user_id")).alias("split"))


@query("q_x8_window_bounds", common("SELECT user_id, event_timestamp, event_timestamp + 7 * 86400 AS window_start, event_timestamp + 8 * 86400 AS window_end FROM ev"))
def x8(spark, d):
    from ..functions.timing import DAY

    ts = F.col("event_timestamp")
    return tables.events(spark, d).select("user_id", ts, (ts + 7 * DAY).alias("window_start"), (ts + 8 * DAY).alias("window_end"))


@query("q_x9_epoch_seconds", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS event_timestamp FROM events")
def x9(spark, d):
    from ..functions.timing import epoch_seconds

    return tables.table(spark, d, "events", ["event_id", "ts"]).select("event_id", epoch_seconds(F.col("ts")).alias("event_timestamp"))


@query("q_x10_round_to_long", "SELECT event_id, CAST(round_even(value, 0) AS BIGINT) AS whole FROM events")
def x10(spark, d):
    return tables.table(spark, d, "events", ["event_id", "value"]).select("event_id", rounded_long(F.col("value")).alias("whole"))
