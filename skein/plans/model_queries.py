"""Queries on text functions, transition models, features, metrics, reports and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.timing import hash_split
from ..functions.vectors import clip_probability, entropy, l2_normalize
from ..operators import decompose, features, markov, metrics, normalize, prep, probes, ranged, report
from ..sources import files, tables
from ..sources.scratch import scratch_path, staged
from ..streaming.ingest import ingest_new_files
from ..streaming.manifest import read_output, run_incremental
from .base import DAYS, LENGTHS, PREFIX_KEYS, common, kept_prefixes, prefixes, query, text


def rounded(df, *columns, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


# ---- text and JSON


@query("q_x1_normalize_text", r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations)
  SELECT conv_id, turn, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '...' ELSE t END AS text FROM t""")  # fmt: skip
def x1(spark, d):
    return X.cleaned(tables.table(spark, d, "conversations", ["conv_id", "turn", "text"]), "text", "text")


@query("q_x2_path_part", r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations)
  SELECT conv_id, turn, replace(CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '...' ELSE t END, '.', '_') AS part FROM t""")  # fmt: skip
def x2(spark, d):
    return tables.table(spark, d, "conversations", ["conv_id", "turn", "text"]).select("conv_id", "turn", X.normalize_path_part(F.col("text")).alias("part"))


_ODD = "CASE event_id % 5 WHEN 0 THEN ' ' || CAST(event_id % 1000 AS VARCHAR) || ',5 ' WHEN 1 THEN CAST(event_id AS VARCHAR) || 'e5' WHEN 2 THEN '-.' || CAST(event_id % 7 AS VARCHAR) WHEN 3 THEN '1,' || CAST(event_id AS VARCHAR) || '.5' ELSE '+' || CAST(event_id AS VARCHAR) END"


@query("q_x3_parse_numeric", rf"SELECT event_id, CASE WHEN regexp_matches(replace(trim(s), ',', '.'), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$') THEN TRY_CAST(replace(trim(s), ',', '.') AS DOUBLE) END AS number FROM (SELECT event_id, {_ODD} AS s FROM events)")
def x3(spark, d):
    raw = tables.table(spark, d, "events", ["event_id"]).selectExpr("event_id", _ODD.replace("VARCHAR", "STRING") + " AS s")
    return raw.select("event_id", X.parse_numeric_text(F.col("s")).alias("number"))


@query("q_x3_props_numbers", "SELECT event_id, TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) AS number FROM events")
def x3_props(spark, d):
    """The numbers of the payloads as they are."""
    raw = tables.table(spark, d, "events", ["event_id", "props"])
    return raw.select("event_id", X.parse_numeric_text(F.get_json_object("props", "$.k")).alias("number"))


_VALUE = "CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN -value WHEN 2 THEN 0 ELSE value / 1000 END"


@query("q_x4_numeric_bucket", f"""SELECT event_id, CASE WHEN v IS NULL THEN NULL WHEN v = 0 THEN 'zero' ELSE (CASE WHEN v > 0 THEN 'pos_' ELSE 'neg_' END) || CASE WHEN abs(v) < 1 THEN 'lt_1'
  ELSE CAST(CAST(pow(2, floor(log2(abs(v)))) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(pow(2, floor(log2(abs(v))) + 1) AS BIGINT) AS VARCHAR) END END AS bucket FROM (SELECT event_id, {_VALUE} AS v FROM events)""")  # fmt: skip
def x4(spark, d):
    return tables.table(spark, d, "events", ["event_id", "value"]).selectExpr("event_id", f"{_VALUE} AS v").select("event_id", X.numeric_bucket(F.col("v")).alias("bucket"))


_NESTED = "'{\"a\":{\"n\":' || CAST(event_id % 100 AS VARCHAR) || '},\"list\":[\"' || event_type || '\",true],\"z\":null}'"


@query("q_x15_leaves", f"""WITH e AS (SELECT DISTINCT event_id % 100 AS n, event_type, {_NESTED} AS event_json FROM events)
  SELECT event_json, 1 AS place, 'a_n' AS path, CAST(n AS VARCHAR) AS text FROM e UNION ALL SELECT event_json, 2, 'list[0]', event_type FROM e
  UNION ALL SELECT event_json, 3, 'list[1]', 'True' FROM e UNION ALL SELECT event_json, 4, 'z', 'None' FROM e""")  # fmt: skip
def x15(spark, d):
    payloads = tables.table(spark, d, "events").selectExpr(_NESTED.replace("VARCHAR", "STRING") + " AS event_json").distinct()
    return normalize.payload_leaves(payloads).select("event_json", "place", "path", "text")


@query("q_x16_parse_payload", f"""WITH e AS (SELECT DISTINCT event_id % 100 AS n, event_type, {_NESTED} AS event_json FROM events)
  SELECT event_json, 'a list z' AS json_top_keys, 'a_n list[0] list[1] z' AS json_leaf_paths, 'path=a_n path=list[0] cat=list[0]:' || event_type || ' path=list[1] cat=list[1]:True path=z cat=z:None' AS attribute_tokens,
  'num=a_n:' || CASE WHEN n = 0 THEN 'zero' ELSE 'pos_' || CAST(CAST(pow(2, floor(log2(n))) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(pow(2, floor(log2(n)) + 1) AS BIGINT) AS VARCHAR) END AS numeric_bucket_tokens,
  event_json AS event_json_canonical, '' AS json_parse_error FROM e""")  # fmt: skip
def x16(spark, d):
    payloads = tables.table(spark, d, "events").selectExpr(_NESTED.replace("VARCHAR", "STRING") + " AS event_json").distinct()
    arrays = [text(c) for c in ("json_top_keys", "json_leaf_paths", "attribute_tokens", "numeric_bucket_tokens")]
    return normalize.parse_payloads(payloads).select("event_json", *arrays, "event_json_canonical", "json_parse_error")


_BUCKET = "CASE WHEN n = 0 THEN 'zero' WHEN n < 0 THEN 'neg' ELSE 'pos_' || CAST(CAST(pow(2, floor(log2(n))) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(pow(2, floor(log2(n)) + 1) AS BIGINT) AS VARCHAR) END"


@query("q_x16_props_payload", f"""SELECT event_json, array_to_string(ks, ' ') AS json_top_keys, array_to_string(ks, ' ') AS json_leaf_paths, array_to_string(['path=' || k for k in ks], ' ') AS attribute_tokens,
  'num=' || ks[1] || ':' || {_BUCKET} AS numeric_bucket_tokens, '{{"' || ks[1] || '":' || CAST(n AS VARCHAR) || '}}' AS event_json_canonical, '' AS json_parse_error
  FROM (SELECT DISTINCT props AS event_json, list_sort(json_keys(props)) AS ks, CAST(json_extract(props, '$.k') AS BIGINT) AS n FROM events)""")  # fmt: skip
def x16_props(spark, d):
    """The payloads of the events as they are."""
    payloads = tables.events(spark, d).select("event_json").distinct()
    arrays = [text(c) for c in ("json_top_keys", "json_leaf_paths", "attribute_tokens", "numeric_bucket_tokens")]
    return normalize.parse_payloads(payloads).select("event_json", *arrays, "event_json_canonical", "json_parse_error")


@query("q_x11_array_work", common("SELECT user_id, prefix_len, list_unique(ids) AS n_distinct, ids[-1] AS last, array_to_string(ids[2:4], ' ') AS part FROM px"))
def x11(spark, d):
    ids = F.col("event_token_ids")
    rows = prefixes(spark, d)
    return rows.select("user_id", "prefix_len", F.size(F.array_distinct(ids)).cast("long").alias("n_distinct"), F.element_at(ids, -1).alias("last"), F.array_join(F.transform(F.slice(ids, 2, 3), lambda x: x.cast("string")), " ").alias("part"))


@query("q_x12_entropy", "SELECT o_custkey, round(0 - sum(p * ln(p)), 6) AS entropy FROM (SELECT o_custkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS p FROM orders) GROUP BY 1")
def x12(spark, d):
    rows = tables.table(spark, d, "orders", ["o_custkey", "o_totalprice"]).groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return rows.select("o_custkey", F.round(entropy(F.transform("v", lambda x: x / total)), 6).alias("entropy"))


@query("q_x13_clip", "SELECT event_id, least(greatest(value / 100, 0.000001::DOUBLE), 1 - 0.000001::DOUBLE) AS p FROM events")
def x13(spark, d):
    return tables.table(spark, d, "events", ["event_id", "value"]).select("event_id", clip_probability(F.col("value") / 100).alias("p"))


@query("q_x14_l2_normalize", "SELECT vec_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)")
def x14(spark, d):
    rows = tables.table(spark, d, "embeddings", ["vec_id", "embedding"]).select("vec_id", l2_normalize(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


_KEYED = "SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations"
_CLEANED = "CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '...' ELSE t END"


@query("q_x5_canonical_json", f"""SELECT DISTINCT '{{"a key":[' || CAST(to_json({_CLEANED}) AS VARCHAR) || ',1,true],"b":{{"c":null}}}}' AS event_json_canonical FROM ({_KEYED})""")
def x5(spark, d):
    rows = tables.table(spark, d, "conversations", ["text"])
    quoted = F.regexp_extract(F.to_json(F.array(F.coalesce("text", F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    payload = F.concat(F.lit('{"b" : {"c":null}, " a  key ": ['), quoted, F.lit(" , 1, true]}"))
    return normalize.payload_keys(rows.select(payload.alias("event_json")).distinct()).select("event_json_canonical").distinct()


@query("q_x15_props_leaves", "SELECT DISTINCT props AS event_json, CAST(row_number() OVER (PARTITION BY props ORDER BY k) AS INTEGER) AS place, k AS path, json_extract_string(props, '$.' || k) AS text FROM (SELECT DISTINCT props, unnest(json_keys(props)) AS k FROM events)")
def x15_props(spark, d):
    payloads = tables.events(spark, d).select("event_json").distinct()
    return normalize.payload_leaves(payloads).select("event_json", "place", "path", "text")


# ---- transitions


def _train(rows):
    return rows.filter("split = 'train'")


@query("q_a6_transitions", common("SELECT l AS last_event_token_id, n AS next_event_token_id, c AS count FROM tr"))
def a6(spark, d):
    return markov.transitions(_train(prefixes(spark, d)))


@query("q_a7_markov_stats", common("SELECT l AS last_event_token_id, n AS next_event_token_id, c AS count, CAST(total AS BIGINT) AS total_count, rank, round(c / total, 6) AS prob FROM mk"))
def a7(spark, d):
    return rounded(markov.markov_stats(_train(prefixes(spark, d))), "prob")


@query("q_w8_top_successors", common("SELECT l AS last_event_token_id, n AS next_event_token_id, rank FROM mk WHERE rank <= 3"))
def w8(spark, d):
    return markov.markov_stats(_train(prefixes(spark, d)), 3).select("last_event_token_id", "next_event_token_id", "rank")


@query("q_t4_popular", common("SELECT n AS next_event_token_id, c AS count FROM pop"))
def t4(spark, d):
    return markov.popular(_train(prefixes(spark, d)))


@query("q_j9_successors", common("""SELECT user_id, prefix_len, coalesce(array_to_string(s.succ, ' '), '') AS succ FROM px LEFT JOIN (SELECT l, list(n ORDER BY rank) AS succ FROM mk GROUP BY 1) s ON l = last_event_token_id"""))
def j9(spark, d):
    rows = kept_prefixes(spark, d)
    df = markov.last_token(rows).join(markov.successors(markov.markov_stats(_train(rows))), "last_event_token_id", "left")
    succ = F.array_join(F.transform("succ", lambda x: x["next"].cast("string")), " ")
    return df.select("user_id", "prefix_len", F.coalesce(succ, F.lit("")).alias("succ"))


_RANKS = """SELECT split, prefix_len, '{name}' AS model_name, round(avg(CASE WHEN p > 0 THEN 1.0::DOUBLE / p ELSE 0 END), 6) AS mrr_at_10, round(avg(CASE WHEN p > 0 AND p <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_5,
  round(avg(CASE WHEN p > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_10, count(*) AS num_rows FROM (SELECT px.*, coalesce(list_position({pred}, next_event_token_id), 0) AS p FROM px
  LEFT JOIN (SELECT l, list(n ORDER BY rank) AS succ FROM mk GROUP BY 1) s ON l = last_event_token_id, (SELECT list(n ORDER BY rank) AS popular FROM pop) WHERE next_event_token_id IS NOT NULL) GROUP BY 1, 2"""
_POPULAR, _MARKOV = _RANKS.format(name="MostPopular", pred="popular"), _RANKS.format(name="Markov1", pred="list_concat(coalesce(succ, []), popular)[1:10]")
_SHARES = ("mrr_at_10", "hit_at_5", "hit_at_10")


@query("q_m8_most_popular", common(_POPULAR))
def m8(spark, d):
    rows = kept_prefixes(spark, d)
    return rounded(metrics.rank_metrics(markov.predict_popular(rows, _train(rows)), "MostPopular"), *_SHARES)


@query("q_m9_markov_predictor", common(_MARKOV))
def m9(spark, d):
    rows = kept_prefixes(spark, d)
    return rounded(metrics.rank_metrics(markov.predict_markov(rows, _train(rows)), "Markov1"), *_SHARES)


@query("q_u2_sequence_metrics", common(_POPULAR + " UNION ALL " + _MARKOV))
def u2(spark, d):
    return report.union_all([m8(spark, d), m9(spark, d)])


@query("q_a11_rank_metrics", common(_POPULAR.replace("popular, next_event_token_id", "popular[1:3], next_event_token_id")))
def a11(spark, d):
    rows = kept_prefixes(spark, d)
    return rounded(metrics.rank_metrics(markov.predict_popular(rows, _train(rows)), "MostPopular", k=3), *_SHARES)


# ---- features

_STATS = """SELECT user_id, prefix_len, list_unique(ids) AS unique_event_count, len(ids) - list_unique(ids) AS repeat_count, round((len(ids) - list_unique(ids)) / len(ids), 6) AS repeat_rate,
  round((SELECT -sum(n / len(ids) * ln(n / len(ids))) FROM (SELECT count(*) AS n FROM unnest(ids) AS u(x) GROUP BY x)), 6) AS event_entropy,
  CAST(list_sum(flags) AS BIGINT) AS session_boundary_count, round(list_avg(gaps), 6) AS gap_mean, round(list_stddev_pop(gaps), 6) AS gap_std, list_max(gaps) AS gap_max FROM px"""


@query("q_a8_sequence_features", common(_STATS))
def a8(spark, d):
    return rounded(features.sequence_features(prefixes(spark, d), PREFIX_KEYS), "repeat_rate", "event_entropy", "gap_mean", "gap_std")


_MARKOV_COLUMNS = ["markov_last_total_count", "markov_top1_prob", "markov_top10_entropy", "markov_actual_prob", "markov_actual_rank"]
_MARKOV_FEATURES = """SELECT px.user_id, px.prefix_len, round(coalesce(t, 0)::DOUBLE, 6) AS markov_last_total_count, round(coalesce(m / t, 0), 6) AS markov_top1_prob, round(coalesce(e, 0), 6) AS markov_top10_entropy,
  round(a.c / t, 6) AS markov_actual_prob, round(a.rank::DOUBLE, 6) AS markov_actual_rank FROM px
  LEFT JOIN (SELECT l, any_value(t) AS t, max(c) AS m, -sum(c / t * ln(c / t)) AS e FROM (SELECT l, c, sum(c) OVER (PARTITION BY l) AS t FROM mk) GROUP BY 1) s ON s.l = px.last_event_token_id
  LEFT JOIN mk a ON a.l = px.last_event_token_id AND a.n = px.next_event_token_id"""


@query("q_f1_markov_features", common(_MARKOV_FEATURES))
def f1(spark, d):
    rows = kept_prefixes(spark, d)
    out = markov.markov_features(rows, markov.markov_stats(_train(rows)))
    return rounded(out.select("user_id", "prefix_len", *_MARKOV_COLUMNS), *_MARKOV_COLUMNS)


@query("q_f2_hashed_terms", common("""SELECT user_id, prefix_len, term, count(*) AS count FROM (SELECT user_id, prefix_len, unnest(list_concat(list_concat(list_transform(ids, lambda x: 'u=' || x),
  list_transform(range(1, len(ids)), lambda i: 'b=' || ids[i] || '_' || ids[i + 1])), list_transform(range(1, 6), lambda i: 'last' || i || '=' || ids[-i]))) AS term FROM px) GROUP BY ALL"""))  # fmt: skip
def f2(spark, d):
    rows = features.hashed_terms(prefixes(spark, d))
    return rows.select("user_id", "prefix_len", F.explode("terms").alias("term")).groupBy("user_id", "prefix_len", "term").agg(F.count("*").alias("count"))


@query("q_f3_feature_hashing", common("SELECT user_id, prefix_len, CAST(2 * len(ids) - 1 + least(5, len(ids)) AS DOUBLE) AS n_terms FROM px"))
def f3(spark, d):
    cells = features.stacked_cells(features.hashed_terms(prefixes(spark, d)), PREFIX_KEYS)
    return cells.select(*PREFIX_KEYS, F.aggregate("val", F.lit(0.0), lambda s, x: s + x).alias("n_terms"))


_NUMBERS = (
    "prefix_len", "num_events_total", "unique_event_count", "event_entropy", "repeat_count", "repeat_rate", "session_boundary_count", "gap_mean", "gap_std", "gap_max",
    "markov_last_total_count", "markov_top1_prob", "markov_top10_entropy", *[f"last_event_{i}" for i in range(1, 6)],
)


def _decomposed(rows, dense):
    """Hashed terms of all prefixes with the numeric columns behind them, in 128 components."""
    terms = features.hashed_terms(rows).select(*PREFIX_KEYS, "terms")
    joined = terms.join(dense, PREFIX_KEYS).select("user_id", "split", "prefix_len", "terms", *[F.col(c).alias(f"x_{c}") for c in _NUMBERS])
    cells = features.stacked_cells(joined, ["user_id", "split", "prefix_len"], dense=tuple(f"x_{c}" for c in _NUMBERS))
    return decompose.truncated_svd(cells, ["user_id", "split", "prefix_len"])


@query("q_f4_truncated_svd")
def f4(spark, d):
    rows = kept_prefixes(spark, d)
    return _decomposed(rows, _dense(rows))[0]


@query("q_f5_explained_variance")
def f5(spark, d):
    rows = kept_prefixes(spark, d)
    return _decomposed(rows, _dense(rows))[1]


@query("q_f4_energy", """SELECT l_orderkey, l_linenumber, CAST(2 * (l_quantity * l_quantity + l_linenumber * l_linenumber) + (100 * l_discount) * (100 * l_discount) + (100 * l_tax) * (100 * l_tax) AS BIGINT) AS energy
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, round(l_discount, 2) AS l_discount, round(l_tax, 2) AS l_tax FROM lineitem)""")  # fmt: skip
def f4_energy(spark, d):
    """Six columns of rank four in four components: each row keeps its whole squared length."""
    rows = tables.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    names = ["l_quantity", "l_linenumber", "l_discount", "l_tax"]
    number = {c: (F.round(F.col(c) * 100) if c in names[2:] else F.col(c)).cast("double") for c in names}
    cells = rows.select("l_orderkey", "l_linenumber", F.array(*[F.lit(i) for i in range(6)]).alias("idx"), F.array(*[number[c] for c in [*names, *names[:2]]]).alias("val"))
    out, _ = decompose.truncated_svd(cells, ["l_orderkey", "l_linenumber"], 4)
    energy = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    return out.select("l_orderkey", "l_linenumber", F.round(energy).cast("long").alias("energy"))


def _dense(rows):
    return features.dense_features(rows, markov.markov_stats(_train(rows)), PREFIX_KEYS)


@query("q_f6_feature_table", common(f"""SELECT s.*, f.* EXCLUDE (user_id, prefix_len), p.split, p.last_event_1, p.last_event_5 FROM ({_STATS}) s JOIN ({_MARKOV_FEATURES}) f ON s.user_id = f.user_id AND s.prefix_len = f.prefix_len
  JOIN (SELECT user_id, prefix_len, split, ids[-1] AS last_event_1, ids[-5] AS last_event_5 FROM px) p ON s.user_id = p.user_id AND s.prefix_len = p.prefix_len"""))  # fmt: skip
def f6(spark, d):
    names = ["unique_event_count", "repeat_count", "repeat_rate", "event_entropy", "session_boundary_count", "gap_mean", "gap_std", "gap_max"]
    out = _dense(kept_prefixes(spark, d)).select("user_id", "prefix_len", *names, *_MARKOV_COLUMNS, "split", "last_event_1", "last_event_5")
    return rounded(out, "repeat_rate", "event_entropy", "gap_mean", "gap_std", *_MARKOV_COLUMNS)


# ---- training rows


#: CLS and the longest prefix.
_INPUT_LENGTH = max(LENGTHS) + 1


@query("q_d1_model_inputs", common("""SELECT user_id, prefix_len, array_to_string(list_concat(([3] || ids)[1:51], list_transform(range(greatest(0, 51 - len(ids) - 1)), lambda x: 0)), ' ') AS input_ids,
  array_to_string(list_transform(range(51), lambda i: CASE WHEN i < len(ids) + 1 THEN 1 ELSE 0 END), ' ') AS attention_mask FROM px"""))  # fmt: skip
def d1(spark, d):
    rows = prep.model_inputs(prefixes(spark, d), _INPUT_LENGTH)
    return rows.select("user_id", "prefix_len", text("input_ids"), text("attention_mask"))


_U = "CAST(concat('0x', substr(sha256('42{k}:' || row || ':' || CAST(pos AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"


def _with_row(rows):
    """One key for user and prefix length."""
    return rows.withColumn("row", F.concat_ws(":", "user_id", F.col("prefix_len").cast("string")))


@query("q_d2_mask_tokens", common(f"""SELECT row, pos, token, CASE WHEN NOT chosen THEN token WHEN uk < 0.8 THEN 2 WHEN ur < 0.1 THEN CAST(floor(ut * 96) AS BIGINT) + 4 ELSE token END AS masked_token, CASE WHEN chosen THEN token ELSE -100 END AS label
  FROM (SELECT *, free AND (u < 0.15 OR row_number() OVER (PARTITION BY row ORDER BY free DESC, u, pos) = 1) AS chosen FROM (SELECT *, token NOT IN (0, 2, 3) AS free, {_U.format(k="m")} AS u, {_U.format(k="k")} AS uk, {_U.format(k="r")} AS ur, {_U.format(k="t")} AS ut
  FROM (SELECT user_id || ':' || CAST(prefix_len AS VARCHAR) AS row, CAST(unnest(range(51)) AS INTEGER) AS pos, unnest([3] || ids || list_transform(range(50 - len(ids)), lambda x: 0)) AS token FROM px)))"""))  # fmt: skip
def d2(spark, d):
    return prep.mask_tokens(prep.model_inputs(_with_row(prefixes(spark, d)), _INPUT_LENGTH), "row", vocab_size=100)


_DRAW = "CAST(concat('0x', substr(sha256('{k}:' || {of}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
_VIEWS = f"""SELECT user_id, prefix_len, view_kind, array_to_string(CASE view_kind WHEN 'crop' THEN ids[start + 1 : start + part] WHEN 'mask' THEN [CASE WHEN list_contains(p_all[1:part], i) THEN 2 ELSE ids[i + 1] END for i in range(n)]
    ELSE list_concat(list_concat(ids[1:start], [ids[start + 1 + i] for i in p_part]), ids[start + part + 1 : n]) END, ' ') AS event_token_ids FROM (
  SELECT *, (SELECT list(i ORDER BY {_DRAW.format(k="1p", of="v.row || ':' || CAST(i AS VARCHAR)")}, i) FROM (SELECT unnest(range(v.n)) AS i)) AS p_all, (SELECT list(i ORDER BY {_DRAW.format(k="1p", of="v.row || ':' || CAST(i AS VARCHAR)")}, i) FROM (SELECT unnest(range(v.part)) AS i)) AS p_part FROM (
  SELECT *, CAST(floor({_DRAW.format(k="1start", of="row")} * (n - part + 1)) AS BIGINT) AS start FROM (
  SELECT *, least(n, CASE view_kind WHEN 'crop' THEN greatest(1, round_even(n * (1 - 0.4::DOUBLE), 0)) WHEN 'reorder' THEN greatest(2, round_even(n * 0.3::DOUBLE, 0)) ELSE greatest(1, round_even(n * 0.3::DOUBLE, 0)) END)::BIGINT AS part FROM (
  SELECT *, CASE WHEN u >= 1 - 0.3::DOUBLE THEN 'reorder' WHEN u >= 1 - (0.3::DOUBLE + 0.4::DOUBLE) THEN 'crop' ELSE 'mask' END AS view_kind FROM (
  SELECT *, len(ids) AS n, {_DRAW.format(k="1op", of="row")} AS u FROM (SELECT *, user_id || ':' || CAST(prefix_len AS VARCHAR) AS row FROM px))))) v)"""


@query("q_d3_augmented_views", common(_VIEWS))
def d3(spark, d):
    rows = _with_row(prefixes(spark, d))
    return prep.augmented_view(rows, "row", {"mask": 0.3, "crop": 0.4, "reorder": 0.3}, "1").select("user_id", "prefix_len", "view_kind", text("event_token_ids"))


def _id_vectors(rows):
    """(token, vector) of x / 7 and x * x, for tokens and CLS."""
    ids = rows.select(F.explode("event_token_ids").alias("token")).union(rows.select(F.lit(prep.CLS).cast("long"))).distinct()
    return ids.select("token", F.array(F.col("token") / 7.0, (F.col("token") * F.col("token")).cast("double")).alias("vector"))


@query("q_d4_pooled_mean", common("""SELECT user_id, prefix_len, round(avg(id_part), 6) AS m0, round(avg(square_part), 6) AS m1 FROM (SELECT user_id, prefix_len, CAST(unnest(ids) AS DOUBLE) / 7 AS id_part, CAST(unnest(ids) * unnest(ids) AS DOUBLE) AS square_part FROM px) GROUP BY 1, 2"""))
def d4(spark, d):
    rows = prefixes(spark, d)
    out = prep.pooled(rows, PREFIX_KEYS, _id_vectors(rows), "mean")
    return out.select(*PREFIX_KEYS, F.round(F.col("embedding")[0], 6).alias("m0"), F.round(F.col("embedding")[1], 6).alias("m1"))


@query("q_d4_pooled_cls_last", common("SELECT user_id, prefix_len, round(3 / 7.0::DOUBLE, 6) AS c0, 9.0::DOUBLE AS c1, round(ids[-1] / 7.0::DOUBLE, 6) AS l0, CAST(ids[-1] * ids[-1] AS DOUBLE) AS l1 FROM px"))
def d4_cls(spark, d):
    rows = prefixes(spark, d)
    out = prep.pooled(rows, PREFIX_KEYS, _id_vectors(rows), "cls+last")
    return out.select(*PREFIX_KEYS, *[F.round(F.col("embedding")[i], 6).alias(c) for i, c in enumerate(("c0", "c1", "l0", "l1"))])


@query("q_d4_sequence_embeddings")
def d4_learned(spark, d):
    rows = kept_prefixes(spark, d)
    return prep.pooled(rows, PREFIX_KEYS, prep.token_vectors(_train(rows), 8), "mean+last")


def _make_model():
    def run(inputs):
        return inputs.mean(axis=1)

    return run


@query("q_d5_batch_inference", "SELECT vec_id, round(list_avg(embedding), 4) AS score FROM embeddings")
def d5(spark, d):
    df = tables.table(spark, d, "embeddings", ["vec_id", "embedding"]).withColumn("x", F.col("embedding").cast("array<double>"))
    width = len(df.select("x").first().x)
    return prep.predict(df, _make_model, ["x"], "score", [[width]]).select("vec_id", F.round("score", 4).alias("score"))


# ---- metrics


_PROB = "CAST(concat('0x', substr(sha256('p:' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
_SCORED = f"WITH s AS (SELECT doc_id, quality AS label, toxic AS grp, round(0.5 * {_PROB} + 0.3 * quality, 2) AS prob FROM labels), "
_BINARY = {
    "num_rows": "count(*)",
    "positive_rate": "round(avg(label), 6)",
    "f1": "round(CASE WHEN sum(CAST(prob >= 0.5 AS INT)) + sum(label) > 0 THEN 2.0::DOUBLE * sum(CAST(prob >= 0.5 AS INT) * label) / (sum(CAST(prob >= 0.5 AS INT)) + sum(label)) ELSE 0 END, 6)",
    "logloss": "round(avg(-(label * ln(least(greatest(prob, 0.000001), 0.999999)) + (1 - label) * ln(1 - least(greatest(prob, 0.000001), 0.999999)))), 6)",
}
_AUC = """auc AS (SELECT a.grp, CASE WHEN sum(a.label) > 0 AND sum(a.label) < count(*) THEN round((sum(a.label * rk) - sum(a.label) * (sum(a.label) + 1) / 2.0) / (sum(a.label) * (count(*) - sum(a.label))), 6) END AS roc_auc
  FROM (SELECT *, rank() OVER (PARTITION BY grp ORDER BY prob) + (count(*) OVER (PARTITION BY grp, prob) - 1) / 2.0 AS rk FROM s) a GROUP BY 1), """
_AP = """ap AS (SELECT grp, round(sum(pos::DOUBLE * tp / n) / sum(pos), 6) AS pr_auc FROM (SELECT grp, pos, sum(pos) OVER w AS tp, sum(k) OVER w AS n FROM
  (SELECT grp, prob, sum(label) AS pos, count(*) AS k FROM s GROUP BY 1, 2) WINDOW w AS (PARTITION BY grp ORDER BY prob DESC)) GROUP BY 1)"""


def _scored(spark, d):
    p = F.conv(F.substring(F.sha2(F.concat(F.lit("p:"), F.col("doc_id").cast("string")), 256), 1, 13), 16, 10).cast("double") / float(2**52)
    rows = tables.table(spark, d, "labels")
    return rows.select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("grp"), F.round(0.5 * p + 0.3 * F.col("quality"), 2).alias("prob"))


def _binary(spark, d):
    return rounded(metrics.binary_metrics(_scored(spark, d), ["grp"]), "positive_rate", "roc_auc", "pr_auc", "f1", "logloss")


@query("q_b1_roc_auc", _SCORED + _AUC.rstrip(", ") + " SELECT grp, roc_auc FROM auc")
def b1(spark, d):
    return _binary(spark, d).select("grp", "roc_auc")


@query("q_b2_average_precision", _SCORED + _AP + " SELECT grp, pr_auc FROM ap")
def b2(spark, d):
    return _binary(spark, d).select("grp", "pr_auc")


@query("q_b3_f1", _SCORED.rstrip(", ") + f" SELECT grp, {_BINARY['f1']} AS f1 FROM s GROUP BY 1")
def b3(spark, d):
    return _binary(spark, d).select("grp", "f1")


@query("q_b4_log_loss", _SCORED.rstrip(", ") + f" SELECT grp, {_BINARY['logloss']} AS logloss FROM s GROUP BY 1")
def b4(spark, d):
    return _binary(spark, d).select("grp", "logloss")


@query("q_a13_positive_rate", _SCORED.rstrip(", ") + " SELECT grp, count(*) AS num_rows, round(avg(label), 6) AS positive_rate FROM s GROUP BY 1")
def a13(spark, d):
    return _binary(spark, d).select("grp", "num_rows", "positive_rate")


@query("q_a12_weighted_mean", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem")
def a12(spark, d):
    return rounded(metrics.weighted_mean(tables.table(spark, d, "lineitem", ["l_discount", "l_quantity"]), "l_discount", "l_quantity"), "mean")


@query("q_t7_topk_scores", """WITH sc AS (SELECT o_custkey AS r, o_orderkey AS item, o_totalprice AS score FROM orders), tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, item) AS rank FROM sc) WHERE rank <= 3),
  lb AS (SELECT o_custkey AS r, max(o_orderkey) AS label FROM orders GROUP BY 1) SELECT count(*) AS num_rows, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr
  FROM lb LEFT JOIN tk ON lb.r = tk.r AND lb.label = tk.item""")  # fmt: skip
def t7(spark, d):
    orders = tables.table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_totalprice"])
    scores = orders.select(F.col("o_custkey").alias("r"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"))
    truth = scores.groupBy("r").agg(F.max("item").alias("label"))
    return rounded(metrics.topk_scores(scores, truth, "r", "item", "score", 3), "hit", "mrr")


# ---- reports, on a metrics table made from order lines

_CELLS = """WITH m AS (SELECT l_returnflag AS target, l_linenumber AS prefix_len, 'model' || CAST(l_suppkey % 5 AS VARCHAR) AS model_name, CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split,
  round(avg(l_discount), 9) AS roc_auc, round(avg(l_tax), 9) AS pr_auc, count(*) AS num_rows FROM lineitem GROUP BY 1, 2, 3, 4) """


def _cells(spark, d):
    rows = tables.table(spark, d, "lineitem", ["l_returnflag", "l_linenumber", "l_suppkey", "l_orderkey", "l_discount", "l_tax"])
    split = F.when(F.col("l_orderkey") % 3 == 0, "train").when(F.col("l_orderkey") % 3 == 1, "valid").otherwise("test")
    keys = [F.col("l_returnflag").alias("target"), F.col("l_linenumber").alias("prefix_len"), F.concat(F.lit("model"), (F.col("l_suppkey") % 5).cast("string")).alias("model_name"), split.alias("split")]
    return rows.groupBy(*keys).agg(F.round(F.avg("l_discount"), 9).alias("roc_auc"), F.round(F.avg("l_tax"), 9).alias("pr_auc"), F.count("*").alias("num_rows"))


_BEST = "QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {metric} DESC NULLS LAST, model_name) = 1"


@query("q_w9_best_models", _CELLS + "SELECT * FROM m " + _BEST.format(keys="target, prefix_len, split", metric="roc_auc"))
def w9(spark, d):
    return report.best_by(_cells(spark, d), ["target", "prefix_len", "split"], "roc_auc")


@query("q_j7_test_of_winners", _CELLS + ", w AS (SELECT target, prefix_len, model_name FROM m WHERE split = 'valid' " + _BEST.format(keys="target, prefix_len", metric="roc_auc") + ") SELECT m.* FROM m SEMI JOIN w ON m.target = w.target AND m.prefix_len = w.prefix_len AND m.model_name = w.model_name WHERE split = 'test'")
def j7(spark, d):
    return report.test_of_valid_winners(_cells(spark, d))


@query("q_a14_mean_metrics", _CELLS + "SELECT target, model_name, round(avg(roc_auc), 6) AS roc_auc FROM m GROUP BY 1, 2")
def a14(spark, d):
    return _cells(spark, d).groupBy("target", "model_name").agg(F.round(F.avg("roc_auc"), 6).alias("roc_auc"))


@query("q_a15_split_gap", _CELLS + """SELECT target, prefix_len, model_name, round(avg(roc_auc) FILTER (split = 'valid'), 6) AS valid, round(avg(roc_auc) FILTER (split = 'test'), 6) AS test,
  round(avg(roc_auc) FILTER (split = 'valid') - avg(roc_auc) FILTER (split = 'test'), 6) AS gap FROM m GROUP BY 1, 2, 3""")  # fmt: skip
def a15(spark, d):
    return rounded(report.split_gap(_cells(spark, d), "roc_auc"), "valid", "test", "gap")


@query("q_a15_lift", _CELLS + "SELECT m.target, m.prefix_len, m.split, m.model_name, round(m.roc_auc - b.roc_auc, 6) AS lift FROM m JOIN m b ON b.model_name = 'model0' AND m.target = b.target AND m.prefix_len = b.prefix_len AND m.split = b.split")
def a15_lift(spark, d):
    return rounded(report.lift(_cells(spark, d), "roc_auc", "model0"), "lift")


@query("q_t2_ordered_metrics", _CELLS + "SELECT *, row_number() OVER (ORDER BY target, prefix_len, model_name, split) - 1 AS place FROM m")
def t2(spark, d):
    return ranged.row_numbers(_cells(spark, d), "place", "target", "prefix_len", "model_name", "split")


@query("q_t5_balanced_head", _CELLS + "SELECT target, prefix_len, model_name, split FROM m QUALIFY row_number() OVER (PARTITION BY split ORDER BY target, prefix_len, model_name) <= 4")
def t5(spark, d):
    return report.balanced_head(_cells(spark, d), 12, ["split"], ["target", "prefix_len", "model_name"]).select("target", "prefix_len", "model_name", "split")


@query("q_t6_best_variant", _CELLS + "SELECT * FROM m WHERE model_name IN ('model0', 'model1', 'model2') " + _BEST.format(keys="target", metric="pr_auc"))
def t6(spark, d):
    return report.best_variant(_cells(spark, d), ["model0", "model1", "model2"])


@query("q_p15_display_names", _CELLS + "SELECT target, prefix_len, split, model_name, CASE model_name WHEN 'model0' THEN 'First' WHEN 'model1' THEN 'Second' ELSE model_name END AS model_label FROM m WHERE target IN ('A', 'R')")
def p15(spark, d):
    names = spark.createDataFrame([("model0", "First"), ("model1", "Second")], "name string, label string")
    rows = report.labelled(_cells(spark, d).filter(F.col("target").isin("A", "R")), "model_name", names, "model_label")
    return rows.select("target", "prefix_len", "split", "model_name", "model_label")


# ---- embeddings and probes


@query("q_j5_joined_embeddings", """SELECT vec_id, i, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(2 * len(embedding))) AS i, unnest(list_concat(embedding, list_transform(embedding, lambda x: 2 * x)))::DOUBLE AS x FROM embeddings WHERE vec_id % 2 = 0)""")
def j5(spark, d):
    left = tables.table(spark, d, "embeddings", ["vec_id", "embedding"])
    right = left.filter("vec_id % 2 = 0").select("vec_id", F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"))
    rows = probes.joined_embeddings(left, right, ["vec_id"]).select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


def _probe_table(spark, d):
    """Embeddings as users of one prefix length, with a binary target."""
    rows = tables.table(spark, d, "embeddings").filter("label IS NOT NULL")
    rows = rows.withColumn("user_id", F.col("vec_id").cast("string"))
    return rows.select(
        "user_id", hash_split(F.col("user_id")).alias("split"), F.lit(20).alias("prefix_len"), "embedding", F.lit(True).alias("label_available_target"), (F.col("label") % 2).cast("int").alias("label_target")
    )


def _grid(spark, d, **probes_by_name):
    table = _probe_table(spark, d)
    return probes.evaluation_grid({name: probes.Probe(table, *how) for name, how in probes_by_name.items()}, ["target"], [20])


@query("q_m1_preprocess_modes")
def m1(spark, d):
    return _grid(spark, d, **{m: ("logistic", m, 8) for m in ("raw", "zscore", "l2", "l2_pca")})


_SHARE = "CAST(concat('0x', substr(sha256('42:' || CAST(vec_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
_TRAIN = f"FROM embeddings WHERE label IS NOT NULL AND {_SHARE} < 0.7"


@query("q_m1_moments", f"""SELECT i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS num_rows FROM (SELECT CAST(unnest(range(len(embedding))) AS INTEGER) AS i, unnest(embedding)::DOUBLE AS x {_TRAIN}) GROUP BY i""")
def m1_moments(spark, d):
    """What standardizing rests on: mean and deviation of each column over a cell's training rows."""
    grid = probes.Grid({"m": probes.Probe(_probe_table(spark, d))}, ["target"], [20])
    (n, mean, cov), = probes.moments(grid, grid.train(("logistic",))).values()
    rows = [(i, round(float(m), 6), round(float(v) ** 0.5, 6), int(n)) for i, (m, v) in enumerate(zip(mean, cov.diagonal(), strict=True))]
    return spark.createDataFrame(rows, "i int, mean double, std double, num_rows long")


@query("q_m2_logistic_probe")
def m2(spark, d):
    return _grid(spark, d, main_mean_logreg=("logistic", "zscore"))


_FIT = f"""WITH RECURSIVE e AS (SELECT label, embedding {_TRAIN}), t AS (SELECT DISTINCT label AS target FROM e),
  r AS (SELECT target, (e.label = target)::INT AS y, 10 * embedding[1]::DOUBLE AS x FROM e, t), n AS (SELECT target, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM r GROUP BY 1),
  w AS (SELECT r.target, y, x, CASE WHEN y = 1 THEN n / (2 * pos) ELSE n / (2 * (n - pos)) END AS w FROM r JOIN n ON r.target = n.target),
  s AS (SELECT target, 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM t UNION ALL
    SELECT target, step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
      SELECT s.target, s.step, s.a, s.b, sum(w * (p - y)) AS ga, sum(w * (p - y) * x) + any_value(s.b) AS gb, sum(w * p * (1 - p)) AS haa, sum(w * p * (1 - p) * x) AS hab, sum(w * p * (1 - p) * x * x) + 1 AS hbb
      FROM (SELECT s.target, s.step, s.a, s.b, w.y, w.x, w.w, 1 / (1 + exp(-(s.a + s.b * w.x))) AS p FROM s JOIN w ON s.target = w.target WHERE s.step < 12) s GROUP BY 1, 2, 3, 4)),
  z AS (SELECT * FROM s WHERE step = 12)
  SELECT z.target, round(any_value(z.a), 6) AS intercept, round(any_value(z.b), 6) AS slope, round(sum(w * (ln(1 + exp(z.a + z.b * x)) - y * (z.a + z.b * x))) + any_value(z.b * z.b) / 2, 4) AS loss FROM z JOIN w ON z.target = w.target GROUP BY 1"""


@query("q_m2_fitted_lines", _FIT)
def m2_lines(spark, d):
    """One probe a label on one number, all fitted together; a strictly convex loss has the same optimum in any engine."""
    rows = tables.table(spark, d, "embeddings").filter("label IS NOT NULL").withColumn("user_id", F.col("vec_id").cast("string"))
    targets = sorted(r.label for r in rows.select("label").distinct().collect())
    table = rows.select(
        "user_id", hash_split(F.col("user_id")).alias("split"), F.lit(20).alias("prefix_len"), F.array(F.col("embedding")[0].cast("double") * 10).alias("embedding"),
        *[c for t in targets for c in ((F.col("label") == t).cast("int").alias(f"label_{t}"), F.lit(True).alias(f"label_available_{t}"))],
    )
    grid = probes.Grid({"line": probes.Probe(table)}, [str(t) for t in targets], [20])
    train = grid.train(("logistic",))
    fitted = probes.fit_logistic(grid, train)
    lines = spark.createDataFrame([(i, int(grid.cells[i]["target"]), float(w[0]), float(w[1]), *probes.class_weights(grid.cells[i])) for i, w in fitted.items()], "cell int, target int, a double, b double, w0 double, w1 double")
    margin = F.col("a") + F.col("b") * F.col("vector")[0]
    rows = train.join(F.broadcast(lines), "cell").withColumn("one", F.when(F.col("label") == 1, F.col("w1")).otherwise(F.col("w0")) * (F.log1p(F.exp(margin)) - F.col("label") * margin))
    out = rows.groupBy("target", "a", "b").agg(F.sum("one").alias("sum"))
    return out.select("target", F.round("a", 6).alias("intercept"), F.round("b", 6).alias("slope"), F.round(F.col("sum") + F.col("b") * F.col("b") / 2, 4).alias("loss"))


@query("q_m3_tabular_logistic")
def m3(spark, d):
    return probes.evaluation_grid({"baseline_features_logreg_clean": probes.Probe(_clean(_dense(kept_prefixes(spark, d))), "tabular")}, [f"retention_{x}d" for x in DAYS], LENGTHS)


def _clean(rows):
    """Keys, labels and the numbers that do not give the next event away."""
    return rows.select("user_id", "split", "prefix_len", *[c for c in rows.columns if c.startswith("label_")], *probes.feature_columns(rows))


@query("q_m4_boosted_trees")
def m4(spark, d):
    return _grid(spark, d, boosted=("boosted",))


@query("q_m5_perceptron")
def m5(spark, d):
    return _grid(spark, d, mlp=("perceptron", "zscore"))


@query("q_m6_evaluation_grid")
def m6(spark, d):
    table = _probe_table(spark, d)
    models = {"plain": probes.Probe(table), "scaled": probes.Probe(table, mode="zscore")}
    return probes.evaluation_grid(probes.chosen_models(models, ["plain", "scaled"]), ["target"], [20])


@query("q_m7_fitted_models")
def m7_fitted(spark, d):
    """Every named model on its own table: pooled embeddings, the SVD, the features, and CLS with the SVD.

    Several models read each table, so each is written once.
    """
    rows = kept_prefixes(spark, d)
    dense = staged(_dense(rows), "dense")
    marks = rows.select("user_id", "split", "prefix_len", *[c for c in rows.columns if c.startswith("label_")])
    vectors = staged(prep.token_vectors(_train(rows), 8), "vectors")
    cls, mean = (staged(marks.join(prep.pooled(rows, PREFIX_KEYS, vectors, how), PREFIX_KEYS), "pooled") for how in ("cls+last", "mean"))
    svd = staged(marks.join(_decomposed(rows, dense)[0], ["user_id", "split", "prefix_len"]), "svd")
    models = probes.named_models(cls, mean, svd, dense, leaking=True, perceptrons=True, mode="l2_standardize")
    return probes.evaluation_grid(models, [f"retention_{x}d" for x in DAYS], LENGTHS)


def _named(spark, d):
    """The named models over the embeddings: whole vectors as CLS and mean, halves as the SVD, two numbers as features."""
    rows = tables.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("user_id"), F.lit(20).alias("prefix_len"), "vec_id", "embedding", (F.col("label") % 2).alias("label_x"))
    numbers = rows.select("user_id", "prefix_len", "label_x", F.col("embedding")[0].alias("first"), F.lit(1.0).alias("markov_actual_prob"))
    half = rows.filter("vec_id % 2 = 0").withColumn("embedding", F.slice("embedding", 1, 3))
    rows, half = rows.drop("vec_id"), half.drop("vec_id")
    return probes.named_models(rows, rows, half, numbers, leaking=True, perceptrons=True)


def _sizes(models):
    """Rows of each model's table, its numbers a row and its kind of probe."""
    out = []
    for name, probe in models.items():
        table, kind = probe.table, probe.kind
        width = F.size("embedding") if "embedding" in table.columns else F.lit(len(probes.feature_columns(table, leaking=True)))
        out.append(table.groupBy(width.cast("int").alias("width")).agg(F.count("*").alias("num_rows")).select(F.lit(name).alias("model_name"), F.lit(kind).alias("probe"), "width", "num_rows"))
    return report.union_all(out)


_MODELS = """WITH e AS (SELECT vec_id, CAST(len(embedding) AS INTEGER) AS w FROM embeddings) SELECT model_name, probe, width, num_rows FROM (
  SELECT unnest(['main_cls_logreg', 'main_mean_logreg', 'main_cls_mlp', 'main_mean_mlp']) AS model_name, unnest(['logistic', 'logistic', 'perceptron', 'perceptron']) AS probe, w AS width, n AS num_rows FROM (SELECT w, count(*) AS n FROM e GROUP BY 1)
  UNION ALL SELECT 'baseline_svd_logreg', 'logistic', CAST(least(w, 3) AS INTEGER), count(*) FROM e WHERE vec_id % 2 = 0 GROUP BY 3
  UNION ALL SELECT 'combined_cls_baseline_svd_logreg', 'logistic', CAST(w + least(w, 3) AS INTEGER), count(*) FROM e WHERE vec_id % 2 = 0 GROUP BY 3
  UNION ALL SELECT 'baseline_features_' || unnest(['logreg', 'hgb', 'logreg', 'hgb']) || unnest(['_clean', '_clean', '_legacy', '_legacy']), unnest(['tabular', 'boosted', 'tabular', 'boosted']), CAST(unnest([1, 1, 2, 2]) AS INTEGER), n FROM (SELECT count(*) AS n FROM e))"""


@query("q_m7_named_models", _MODELS)
def m7(spark, d):
    return _sizes(_named(spark, d))


@query("q_p13_chosen_models", _MODELS + " WHERE model_name IN ('main_mean_logreg', 'combined_cls_baseline_svd_logreg')")
def p13(spark, d):
    return _sizes(probes.chosen_models(_named(spark, d), ["combined_cls_baseline_svd_logreg", "main_mean_logreg"]))


@query("q_p9_feature_columns", "SELECT CAST(l_orderkey AS VARCHAR) AS user_id, l_linenumber AS prefix_len, l_quantity AS gap_mean, l_tax AS repeat_rate FROM lineitem")
def p9(spark, d):
    rows = tables.table(spark, d, "lineitem").selectExpr(
        "cast(l_orderkey AS string) AS user_id", "l_returnflag AS split", "l_linenumber AS prefix_len", "l_quantity AS gap_mean", "l_tax AS repeat_rate",
        "l_discount AS markov_actual_prob", "l_suppkey AS next_event_token_id", "l_partkey AS label_retention_7d", "l_linestatus AS note",
    )
    return rows.select("user_id", "prefix_len", *probes.feature_columns(rows))


@query("q_j6_metadata_of_joined", "SELECT vec_id, label, 2 * CAST(len(embedding) AS INTEGER) AS width FROM embeddings WHERE vec_id % 3 = 0")
def j6(spark, d):
    left = tables.table(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    right = left.filter("vec_id % 3 = 0").select("vec_id", "embedding", F.lit(-1).alias("label"))
    return probes.joined_embeddings(left, right, ["vec_id"]).select("vec_id", "label", F.size("embedding").alias("width"))


# ---- sinks and streams


@query("q_s3_zstd_sink", "SELECT user_id, event_type, value FROM events")
def s3(spark, d):
    path = scratch_path(spark, "sink")
    files.write_table(tables.table(spark, d, "events", ["user_id", "event_type", "value"]), path, rows_per_file=100_000)
    return spark.read.parquet(path)


@query("q_s9_metrics_csv", _CELLS + "SELECT target, prefix_len, model_name, split, roc_auc, num_rows FROM m")
def s9(spark, d):
    path, rows = scratch_path(spark, "sink"), _cells(spark, d).drop("pr_auc")
    files.write_metrics(rows, path)
    return files.read_metrics(spark, path, rows.schema).select("target", "prefix_len", "model_name", "split", "roc_auc", "num_rows")


@query("q_s11_partitioned_sink", common("SELECT user_id, split, num_events FROM usr"))
def s11(spark, d):
    from ..operators import sequences, splits

    path = scratch_path(spark, "sink")
    files.write_table(splits.assign_splits(sequences.users(tables.events(spark, d)), None), path, by=["split"])
    return spark.read.parquet(path).select("user_id", "split", "num_events")


_SHARDS = """WITH e AS (SELECT CAST(event_id % 3 AS INTEGER) AS shard, value FROM events), r AS (SELECT * FROM (VALUES (1, 0, 'processed', 20), (1, 1, 'processed', 20), (2, 0, 'skipped_existing', 20), (2, 1, 'skipped_existing', 20), (2, 2, 'processed', 20),
  (3, 0, 'redone', 60), (3, 1, 'redone', 60), (3, 2, 'redone', 60), (4, 0, 'skipped_existing', 60), (4, 1, 'skipped_existing', 60), (4, 2, 'skipped_existing', 60)) t(turn, shard, status, least))
  SELECT turn, shard, status, count(*) AS rows_in, count(*) FILTER (value >= least) AS rows_out, count(*) FILTER (value >= least AND value > 90) AS parse_errors, (SELECT count(*) FROM e WHERE value >= 60) AS rows_at_end FROM r JOIN e USING (shard) GROUP BY ALL"""


@query("q_s6_incremental", _SHARDS)
def s6(spark, d):
    """Two files, then a third, then another setting, then nothing new."""
    base = scratch_path(spark, "incremental")
    events = tables.table(spark, d, "events", ["event_id", "value"])
    keep = lambda df, how: df.filter(F.col("value") >= how["least"]).withColumn("error", F.when(F.col("value") > 90, "high").otherwise(""))
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{base}/waiting/s{k}")
    fs, path = spark._jvm.org.apache.hadoop.fs, lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{p}")
    files_at = fs.FileSystem.get(path("").toUri(), spark._jsc.hadoopConfiguration())
    files_at.mkdirs(path("in"))
    reports = []
    for turn, (arrive, least) in enumerate((((0, 1), 20), ((2,), 20), ((), 60), ((), 60)), 1):
        for k in arrive:
            files_at.rename(path(f"waiting/s{k}"), path(f"in/s{k}"))
        told = run_incremental(spark, f"{base}/in/*/*.parquet", keep, {"least": least}, f"{base}/out", f"{base}/manifest", errors="error")
        reports.append(staged(told.select(F.lit(turn).alias("turn"), F.regexp_extract("shard", "/s([0-9])/", 1).cast("int").alias("shard"), "status", "rows_in", "rows_out", "parse_errors"), "report"))
    end = read_output(spark, f"{base}/out", f"{base}/manifest").agg(F.count("*").alias("rows_at_end"))
    return report.union_all(reports).join(F.broadcast(end))


@query("q_st1_stream_ingest", "SELECT CAST(user_id AS VARCHAR) AS user_id, 'event=' || trim(event_type) AS event_token FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def st1(spark, d):
    path = scratch_path(spark, "sink")
    schema = spark.read.parquet(f"{d}/events.parquet").schema

    def stages(df):
        rows = df.na.drop(subset=["user_id", "event_type"])
        return rows.select(F.col("user_id").cast("string").alias("user_id"), normalize.event_token(F.col("event_type")).alias("event_token"))

    ingest_new_files(spark, f"{d}/events.parque[t]", schema, stages, f"{path}/out", f"{path}/checkpoint", f"{path}/audit")
    return spark.read.parquet(f"{path}/out").drop("batch")
