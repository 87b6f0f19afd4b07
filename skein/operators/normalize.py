"""Event names and JSON payloads to tokens.  Each distinct payload is parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_path_part, normalize_text, numeric_bucket, parse_numeric_text, py_strip
from .skewed import spread_join

MAX_DEPTH, MAX_LEAVES = 8, 48


def event_token(name: Column) -> Column:
    return F.concat(F.lit("event="), py_strip(name))


def event_signature(token: Column, keys: Column) -> Column:
    joined = F.when(F.size(keys) == 0, F.lit("__empty__")).otherwise(F.array_join(keys, "+"))
    return F.concat(token, F.lit("|json="), joined)


def json_source(payload: Column) -> Column:
    """The payload's text; blank is an empty object."""
    return F.coalesce(F.nullif(py_strip(payload), F.lit("")), F.lit("{}"))


def parsed_json(payload: Column) -> Column:
    """The payload as a variant, null unless its whole text is one JSON value."""
    inside = F.try_parse_json(F.concat(F.lit("["), json_source(payload), F.lit("]")))
    return F.when(F.try_variant_get(inside, "$[1]", "variant").isNull(), F.try_variant_get(inside, "$[0]", "variant"))


#: A JSON text literal, or what stands between two of them.
PIECE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]+'


def cleaned_json(text: Column) -> Column:
    """Compact JSON with its keys and text values trimmed, their white space made single blanks, and cut."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    literal = lambda x: normalize_text(F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0)))
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(literal(x))), r"(?s)^\[(.*)\]$", 1)
    return F.array_join(F.transform(pieces, lambda x: F.when(F.startswith(x, F.lit('"')), quoted(x)).otherwise(x)), "")


def payload_leaves(payloads: DataFrame, max_depth: int = MAX_DEPTH, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """(event_json) to (event_json, place, path, kind, text, number): leaves in document order, keys sorted.

    A fixed chain of outer explodes, one per level; what lies beyond ``max_depth`` is one leaf with
    the text ``__max_depth__``.  Payloads that do not parse have no leaves.
    """
    df = payloads.select("event_json", parsed_json(F.col("event_json")).alias("v"))
    nested = "(schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%')"
    df = df.filter("v IS NOT NULL").selectExpr("event_json", "v", "'' AS path", "cast(array() AS array<int>) AS ord", f"{nested} AS open")
    rooted = F.expr("schema_of_variant(v) LIKE 'OBJECT%'")  # any other root stands below one key of its own
    df = df.withColumn("path", F.when(rooted, "").otherwise("__root__")).withColumn("ord", F.when(rooted, F.col("ord")).otherwise(F.array(F.lit(0))))
    for level in range(max_depth + 1):
        deeper = f"open AND size(ord) = {level}"
        df = _explode_level(df, deeper).filter("NOT (stepped AND pos IS NULL)")
        df = df.withColumn("key_part", normalize_path_part(F.col("key")))
        step = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key_part"))
        df = df.withColumn("path", F.when(F.col("stepped"), step.otherwise(F.concat("path", F.lit("."), "key_part"))).otherwise(F.col("path")))
        df = df.withColumn("ord", F.expr("CASE WHEN stepped THEN array_append(ord, pos) ELSE ord END"))
        df = df.withColumn("v", F.expr("CASE WHEN stepped THEN value ELSE v END"))
        df = df.selectExpr("event_json", "v", "path", "ord", f"{nested} AND size(ord) <= {max_depth} AS open", f"size(ord) = {max_depth + 1} AS cut")
        df = df.drop("cut") if level < max_depth else df
    place = F.row_number().over(Window.partitionBy("event_json").orderBy("ord"))
    leaves = df.withColumn("place", place).filter(F.col("place") <= max_leaves)
    kind = F.when(F.col("cut"), F.lit("STRING")).otherwise(F.expr("schema_of_variant(v)"))
    leaves = leaves.withColumn("kind", kind)
    raw = F.expr("CASE WHEN cut THEN '__max_depth__' ELSE variant_get(v, '$', 'string') END")
    text = F.when(F.col("kind") == "BOOLEAN", F.initcap(raw)).when(F.col("kind") == "VOID", F.lit("None")).otherwise(raw)
    number = F.when(F.col("kind").isin("BOOLEAN", "VOID"), F.lit(None).cast("double")).when(F.col("kind") == "STRING", parse_numeric_text(raw))
    number = number.otherwise(F.expr("CASE WHEN cut THEN NULL ELSE try_variant_get(v, '$', 'double') END"))
    return leaves.select("event_json", "place", normalize_path_part(F.col("path")).alias("path"), "kind", normalize_text(text).alias("text"), number.alias("number"))


def _explode_level(df: DataFrame, deeper: str) -> DataFrame:
    """One level of children for the rows that are open at it; other rows pass."""
    spark = df.sparkSession
    return spark.sql(
        "SELECT d.event_json, d.v, d.path, d.ord, d.open, t.pos, t.key, t.value, d.stepped "
        "FROM (SELECT *, coalesce({cond}, false) AS stepped FROM {df}) d, "
        "LATERAL variant_explode_outer(CASE WHEN d.stepped THEN d.v END) AS t".replace("{cond}", deeper),
        df=df,
    )


def payload_keys(payloads: DataFrame) -> DataFrame:
    """Distinct payloads to top keys, canonical text and error, without walking the leaves."""
    source = json_source(F.col("event_json"))
    parsed = payloads.select("event_json", parsed_json(F.col("event_json")).alias("v")).withColumn("object", F.coalesce(F.expr("schema_of_variant(v) LIKE 'OBJECT%'"), F.lit(False)))
    keys = F.when(F.col("object"), F.transform(F.array_sort(F.json_object_keys(source)), lambda k: normalize_path_part(k))).when(F.col("v").isNull(), F.array().cast("array<string>"))
    return parsed.select(
        "event_json",
        keys.otherwise(F.array(F.lit("__root__"))).alias("json_top_keys"),
        F.when(F.col("v").isNull(), F.lit("{}")).when(F.col("object"), cleaned_json(F.to_json("v"))).otherwise(F.concat(F.lit('{"__root__":'), cleaned_json(F.to_json("v")), F.lit("}"))).alias("event_json_canonical"),
        F.when(F.col("v").isNull(), F.lit("invalid JSON")).otherwise(F.lit("")).alias("json_parse_error"),
    )


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Distinct payloads to top keys, leaf paths, attribute and number tokens, canonical text and error."""
    leaves = payload_leaves(payloads)
    numeric = F.col("number").isNotNull()
    tokens = leaves.select(
        "event_json",
        "place",
        "path",
        F.when(~numeric, F.concat(F.lit("cat="), "path", F.lit(":"), "text")).alias("cat"),
        F.when(numeric, F.concat(F.lit("num="), "path", F.lit(":"), numeric_bucket(F.col("number")))).alias("num"),
    )
    by_place = lambda item: F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("x")))), lambda s: s["x"])
    grouped = tokens.groupBy("event_json").agg(
        by_place(F.col("path")).alias("json_leaf_paths"),
        F.flatten(by_place(F.array_compact(F.array(F.concat(F.lit("path="), "path"), "cat")))).alias("attribute_tokens"),
        F.array_compact(by_place(F.col("num"))).alias("numeric_bucket_tokens"),
    )
    parsed = payload_keys(payloads)
    empty = F.array().cast("array<string>")
    joined = parsed.join(grouped, "event_json", "left")
    return joined.select(
        "event_json", "event_json_canonical", "json_parse_error", "json_top_keys",
        *[F.coalesce(c, empty).alias(c) for c in ("json_leaf_paths", "attribute_tokens", "numeric_bucket_tokens")],
    )


def with_signatures(events: DataFrame) -> DataFrame:
    """Events with token and signature only."""
    keys = payload_keys(events.select("event_json").distinct()).select("event_json", "json_top_keys")
    df = spread_join(events, keys, "event_json").withColumn("event_token", event_token(F.col("event_name")))
    return df.withColumn("event_signature", event_signature(F.col("event_token"), F.col("json_top_keys")))


def normalize_events(events: DataFrame) -> DataFrame:
    """Events with token, signature and the parsed payload's columns."""
    parsed = parse_payloads(events.select("event_json").distinct())
    df = spread_join(events, parsed, "event_json")
    df = df.withColumn("event_name_norm", py_strip(F.col("event_name"))).withColumn("event_token", event_token(F.col("event_name")))
    return df.withColumn("event_signature", event_signature(F.col("event_token"), F.col("json_top_keys")))


def parse_errors(normalized: DataFrame) -> DataFrame:
    return normalized.agg(F.count_if(F.col("json_parse_error") != "").alias("parse_errors"), F.count("*").alias("rows_out"))
