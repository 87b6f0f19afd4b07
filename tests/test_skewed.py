"""Joins with crowded keys: the same rows, spread over the tasks."""

import random

from pyspark.sql import functions as F

from skein.operators import normalize, skewed, vocab


def case(spark, n=6000):
    rng = random.Random(1)
    left = [(k, "{}" if k % 3 else rng.choice([f"k{rng.randrange(900)}", None, "nobody"])) for k in range(n)]
    right = [("{}", 0), *((f"k{k}", k) for k in range(900)), (None, -1)]
    return spark.createDataFrame(left, "id long, k string").repartition(5), spark.createDataFrame(right, "k string, v int")


def test_heavy_keys_are_the_crowded_ones(spark):
    left, _ = case(spark)
    want = left.select(F.xxhash64(F.lit("{}"))).first()[0], left.select(F.xxhash64(F.lit("nobody"))).first()[0], left.select(F.xxhash64(F.lit(None).cast("string"))).first()[0]
    assert {r.heavy for r in skewed.heavy_keys(left, "k").collect()} == set(want)
    assert skewed.heavy_keys(left.filter("false"), "k").count() == 0
    even = left.select(F.col("id").cast("string").alias("k"))
    assert skewed.heavy_keys(even, "k").count() == 0


def test_spread_join_is_the_join(spark):
    left, right = case(spark)
    for how in ("inner", "left"):
        want = left.join(right, "k", how)
        got = skewed.spread_join(left, right, "k", how)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_crowded_key_spreads_over_tasks(spark):
    """Two thirds of the rows hold one key; joined by shuffle, no task gets far more than its share."""
    left, right = case(spark, 24_000)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        most = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        spread = skewed.spread_join(left, right, "k")
        plan = spread._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "__salt" in plan and "ObjectHashAggregate" in plan
        assert most(left.join(right, "k")) > 12_000 and most(spread) < 2 * 24_000 / 16
    finally:
        for key in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_payloads_and_tokens_with_a_crowded_payload(spark):
    rows = [(f"u{k}", "view", "{}" if k % 2 else f'{{"a{k % 7}": {k}}}') for k in range(700)]
    events = spark.createDataFrame(rows, "user_id string, event_name string, event_json string")
    signed = normalize.with_signatures(events)
    got = {r.user_id: r.event_signature for r in signed.collect()}
    assert got == {u: "event=view|json=" + ("__empty__" if j == "{}" else j.split('"')[1]) for u, _, j in rows}
    words = vocab.build_vocab(vocab.frequencies(signed, "event_signature"))
    ids = {r.token: r.id for r in words.collect()}
    encoded = vocab.encode_tokens(signed, words, "event_signature")
    assert {(r.event_signature, r.event_token_id) for r in encoded.collect()} == {(s, ids[s]) for s in got.values()} and encoded.count() == 700
