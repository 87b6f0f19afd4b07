"""Global order, row numbers, running sums and sequences in sorted ranges, with groups and users that span many of them."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import metrics, ranged, sequences, vocab
from skein.sources import files


@pytest.fixture
def many_ranges(monkeypatch):
    """Ranges and blocks of them so small that every group spans several."""
    monkeypatch.setattr(ranged, "LEAST", 24)
    monkeypatch.setattr(ranged, "BLOCK", 3)


def test_row_numbers_of_wide_rows(spark):
    """Columns beyond the order must not change which range a row is in; more rows than the bounds are drawn from."""
    n = 400_000
    wide = spark.range(n).select((F.xxhash64("id") % 1000).alias("a"), F.xxhash64("id").alias("b"), F.sha2(F.col("id").cast("string"), 256).alias("note"))
    r = ranged.row_numbers(wide, "n", "a", "b", ranges=16).agg(F.countDistinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    assert (r.d, r.lo, r.hi) == (n, 0, n - 1)


def test_row_numbers_with_ties_nulls_and_empty(spark, many_ranges):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice([None, 1, 2, 3])) for _ in range(500)] + [("b", 7)] * 700
    df = spark.createDataFrame(rows, "a string, b int").repartition(7)
    got = ranged.row_numbers(df, "n", F.desc("a"), F.asc_nulls_last("b")).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1200))
    key = lambda x: (-ord(x[0]), x[1] is None, x[1] or 0)
    assert [(r.a, r.b) for r in got] == sorted(rows, key=key)
    assert ranged.row_numbers(df.filter("false"), "n", "a").count() == 0


def test_the_number_of_ranges_follows_the_input(spark, tmp_path, monkeypatch):
    spark.range(200_000).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr(ranged, "RANGE_BYTES", size // 40)
    assert 35 <= ranged.range_count(df.filter("id > 3").groupBy("x").count()) <= 45
    assert 75 <= ranged.range_count(df.join(df.withColumnRenamed("x", "y"), "id")) <= 90
    assert ranged.row_numbers(df, "n", "x").filter("n < 0").count() == 0


def test_running_sums_against_one_window(spark, many_ranges):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.random(), rng.randrange(5)) for _ in range(900)] + [(f"g{k}", rng.random(), 1) for k in range(60)] + [("big", rng.random(), 2) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, x double, v int").repartition(5)
    w = Window.partitionBy("g").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"))
    got = ranged.running_sums(df, ["g"], [F.desc("x")], {"s": "v"})
    assert got.columns == ["g", "x", "v", "s"] and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    whole = ranged.running_sums(df, [], ["x"], {"s": "v", "t": "x"}).orderBy("x").collect()
    total = 0
    for r in whole:
        assert r.s == total
        total += r.v


def brute_auc(rows):
    """ROC-AUC by all pairs and average precision by steps over distinct scores."""
    pos, neg = np.array([p for y, p in rows if y]), np.array([p for y, p in rows if not y])
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg)) if len(pos) and len(neg) else None
    scores, ap = np.array([p for _, p in rows]), 0.0
    for s in np.unique(pos):
        ap += (pos == s).sum() / len(pos) * (pos >= s).sum() / (scores >= s).sum()
    return auc, ap


def test_metrics_of_one_group_with_all_scores_distinct(spark, many_ranges):
    rng = random.Random(3)
    rows = [("one", int(rng.random() < 0.2 + 0.5 * p), p) for p in (rng.random() for _ in range(3000))]
    rows += [(f"g{k % 7}", rng.randrange(2), round(rng.random(), 1)) for k in range(300)] + [("all", 1, 0.5), ("none", 0, 0.5), (None, 1, 0.2), (None, 0, 0.2)]
    df = spark.createDataFrame(rows, "g string, label int, prob double").repartition(6)
    out = metrics.binary_metrics(df, ["g"])
    for r in out.collect():
        auc, ap = brute_auc([(y, p) for g, y, p in rows if g == r.g])
        assert (r.roc_auc is None) == (auc is None) and abs((r.roc_auc or 0) - (auc or 0)) < 1e-12 and abs(r.pr_auc - ap) < 1e-12
    assert out.count() == 11
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and all("__range" in x or "__block" in x for x in windows)


def events_of(rng, users):
    return [(u, rng.randrange(max(3, n // 2)) * 40_000, rng.choice(["a", "b", None]), rng.randrange(4, 60)) for u, n in users.items() for _ in range(n)]


def test_sequences_of_a_user_of_half_the_events(spark, many_ranges):
    """Row numbers, gaps, session changes and next tokens by ranges are those of one window a user."""
    rng = random.Random(4)
    rows = events_of(rng, {"big": 2000, "second": 500, **{f"u{k}": rng.randrange(1, 60) for k in range(40)}})
    df = spark.createDataFrame(rows, "user_id string, event_timestamp long, session_id string, event_token_id long").repartition(5)
    names = ["user_id", "event_timestamp", "session_id", "event_token_id", "rn", "num_events_total", "next_token", "gap", "session_change"]
    want = sorted(repr(tuple(r)) for r in sequences._ordered_by_user(df).select(names).collect())
    for most in (10, 400, 1000, 10**9):
        got = sequences.ordered(df, most)
        assert got.select(names).schema == sequences._ordered_by_user(df).select(names).schema or most < 10**9
        assert sorted(repr(tuple(r)) for r in got.select(names).collect()) == want
    sizes = sorted(r["count"] for r in ranged.ranged(df, "user_id", *sequences._order()).groupBy("__range").count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_windows_of_a_crowded_user(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(sequences, "MOST_EVENTS", 100)
    df = spark.createDataFrame([("u", 10 * i, "a" if i < 300 else "b", i) for i in range(1, 501)] + [("v", 1, None, 9)], "user_id string, event_timestamp long, session_id string, event_token_id long")
    s = sequences.ordered(df)
    window = sequences.history_windows(s, 300, 2, "eval").first()
    assert window.event_token_ids == list(range(201, 501)) and window.session_flags == [1, *[0] * 98, 1, *[0] * 200] and window.time_gap_ids == [0, *[2] * 299]
    assert {r.user_id: r.next_event_token_id for r in sequences.prefixes(s, [1]).collect()} == {"u": 2, "v": None}


def test_vocabulary_and_export_span_ranges(spark, many_ranges):
    freq = spark.createDataFrame([(f"t{k:04d}", 2 + k // 50) for k in range(1000)], "token string, count long")
    got = {r.token: r.id for r in vocab.build_vocab(freq).collect()}
    want = sorted(((-(2 + k // 50), f"t{k:04d}") for k in range(1000)))
    assert all(got[t] == 4 + i for i, (_, t) in enumerate(want)) and len(got) == 1004
    rng = random.Random(5)
    df = spark.createDataFrame(events_of(rng, {"big": 3000, "a": 5, "z": 5}), "user_id string, event_timestamp long, session_id string, event_token_id long")
    out = files.sorted_export(df)
    sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sizes) < 1000
    key = lambda r: (r.user_id, r.event_timestamp, r.session_id is None, r.session_id or "", r.event_token_id)
    rows = out.collect()
    assert [key(r) for r in rows] == sorted(map(key, rows)) and len(rows) == 3010


def test_later_rows_of_split_maps_over_files(spark, tmp_path):
    """The last row of the last file holds, though its splits are read first as the larger ones."""
    small = ["1,train", "2,train", "3,val"]
    large = [f"{k},test" for k in range(100, 40_000)] + ["1,tst", "2,valid", "1,val"]
    for name, rows in (("a.csv", small), ("b.csv", large), ("c.csv", ["3,trn"])):
        (tmp_path / name).write_text("\n".join(["u,s", *rows]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        raw = spark.read.option("header", True).csv(str(tmp_path))
        got = {r.user_id: r.split for r in files.clean_split_map(raw, "u", "s").filter("int(user_id) < 10").collect()}
        first = raw.select(F.spark_partition_id().alias("p"), "_metadata.file_name").filter("p = 0").first().file_name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == "b.csv" and got == {"1": "valid", "2": "valid", "3": "train"}
    assert not files.has_files(raw.groupBy("u").count())
