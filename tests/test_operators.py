import pytest
from pyspark.sql import functions as F

from skein.operators import decompose, features, labels, markov, metrics, normalize, prep, report, sequences, splits, vocab
from skein.sources import files
from skein.streaming.ingest import ingest_new_files


def parsed(spark, text):
    return normalize.parse_payloads(spark.createDataFrame([(text,)], "event_json string")).first()


def test_parse_nested(spark):
    r = parsed(spark, '{"b":[1,{"z":"x"}],"a":{"y":null},"t":true,"e":{}}')
    assert r.json_top_keys == ["a", "b", "e", "t"]
    assert r.json_leaf_paths == ["a_y", "b[0]", "b[1]_z", "t"]
    assert r.attribute_tokens == ["path=a_y", "cat=a_y:None", "path=b[0]", "path=b[1]_z", "cat=b[1]_z:x", "path=t", "cat=t:True"]
    assert r.numeric_bucket_tokens == ["num=b[0]:pos_1_2"]


@pytest.mark.parametrize("bad", ["{bad", '"k": 1}', '{"a":1} {"b":2}'])
def test_parse_bad(spark, bad):
    r = parsed(spark, bad)
    assert (r.json_top_keys, r.attribute_tokens, r.event_json_canonical) == ([], [], "{}") and r.json_parse_error


def test_parse_roots_and_depth(spark):
    assert (parsed(spark, "[5]").json_top_keys, parsed(spark, "[5]").json_leaf_paths) == (["__root__"], ["__root__[0]"])
    deep = parsed(spark, '{"a":' * 9 + "1" + "}" * 9)
    assert deep.attribute_tokens[1].endswith(":__max_depth__") and len(deep.json_leaf_paths) == 1
    assert parsed(spark, "").json_parse_error == ""


def test_vocab_and_coverage(spark):
    df = spark.createDataFrame([(x,) for x in "aaabbbc"] + [(None,)], "t string")
    freq = vocab.frequencies(df, "t")
    v = vocab.build_vocab(freq)
    assert {r.token: r.id for r in v.collect()} == {"[PAD]": 0, "[UNK]": 1, "[MASK]": 2, "[CLS]": 3, "a": 4, "b": 5}
    c = vocab.coverage(freq, v).first()
    assert (c.unique_total, c.unique_kept, c.occurrences_oov, round(c.coverage_ratio, 4)) == (3, 2, 1, 0.8571)
    assert vocab.coverage(freq.limit(0), v).first().coverage_ratio == 0.0
    arrays = spark.createDataFrame([(["x", "y", "x"],), (None,)], "t array<string>")
    assert {r.token: r["count"] for r in vocab.frequencies(arrays, "t").collect()} == {"x": 2, "y": 1}
    ids = vocab.encode_tokens(df.na.drop(), v, "t", "id").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in ids} == {4: 3, 5: 3, 1: 1}


def seq(spark, rows):
    return sequences.ordered(spark.createDataFrame(rows, "user_id string, event_timestamp long, session_id string, event_token_id long"))


def test_windows(spark):
    s = seq(spark, [("u", 10 * i, "a" if i < 3 else "b", i) for i in range(1, 6)] + [("v", 1, None, 9)])
    train = sequences.history_windows(s, 3, 2, "train").first()
    assert (train.event_token_ids, train.next_event_token_id, train.time_gap_ids, train.session_flags) == ([2, 3, 4], 5, [0, 2, 2], [1, 1, 0])
    assert sequences.history_windows(s, 3, 2, "eval").first().event_token_ids == [3, 4, 5]
    p = {(r.user_id, r.prefix_len): r for r in sequences.prefixes(s, [1, 2]).collect()}
    assert set(p) == {("u", 1), ("u", 2), ("v", 1)} and p["v", 1].next_event_token_id is None
    assert (p["u", 2].event_token_ids, p["u", 2].time_gap_ids, p["u", 2].session_flags) == ([1, 2], [0, 2], [1, 0])


def test_retention(spark):
    rows = [("u", 0, "a", 1), ("u", 604800, "a", 1), ("w", 0, "a", 1), ("w", 691200, "a", 1)]
    out = {r.user_id: r for r in labels.prefix_labels(seq(spark, rows), [1], [7, 14]).collect()}
    assert out["u"].label_available_retention_7d and out["u"].label_retention_7d == 1 and out["w"].label_retention_7d == 0
    assert not out["u"].label_available_retention_14d and out["u"].label_retention_14d is None
    durations = labels.duration_labels(sequences.users(seq(spark, rows)), [8]).collect()
    assert {r.user_id: r.label_retention_8d for r in durations} == {"u": 0, "w": 1}


def test_checked_label_join(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "user_id string, x int")
    right = spark.createDataFrame([("a", 1), ("b", 0)], "user_id string, label_y int")
    assert labels.join_many_to_one(left, right, ["user_id"]).count() == 2
    for bad in (right.limit(1), right.unionByName(right)):
        with pytest.raises(Exception, match="label"):
            labels.join_many_to_one(left, bad, ["user_id"]).collect()
    assert labels.drop_labels(right).columns == ["user_id"]
    assert labels.metadata_columns(right.withColumn("z", F.lit(1))).columns == ["user_id", "label_y"]


def test_splits(spark):
    raw = spark.createDataFrame([(1, " VAL "), (2, "tst"), (3, "dev"), (1, "valid")], "u int, s string")
    assert {r.user_id: r.split for r in files.clean_split_map(raw, "u", "s").collect()} == {"1": "valid", "2": "test"}
    later = raw.coalesce(1).unionByName(spark.createDataFrame([(2, "train"), (2, "odd")], raw.schema).coalesce(1))
    assert {r.user_id: r.split for r in files.clean_split_map(later, "u", "s").collect()} == {"1": "valid", "2": "train"}
    assert {r.user_id: r.split for r in files.clean_split_map(later, "u", "s", F.col("s")).collect()} == {"1": "valid", "2": "test"}
    with pytest.raises(ValueError):
        splits.assign_splits(raw, raw, "guess")


def frame(spark):
    rows = [("train", 5, [1, 2], [0, 1], [1, 0], 7), ("train", 5, [2, 2], [0, 1], [1, 0], 7), ("train", 5, [3, 2], [0, 1], [1, 0], 8), ("test", 5, [9], [0], [1], 7), ("test", 5, [2], [0], [1], 4), ("test", 5, [2], [0], [1], None)]
    df = spark.createDataFrame(rows, "split string, prefix_len int, event_token_ids array<long>, time_gap_ids array<long>, session_flags array<long>, next_event_token_id long")
    return df.withColumn("user_id", F.monotonically_increasing_id().cast("string"))


def test_markov(spark):
    df = frame(spark)
    train = df.filter("split = 'train'")
    stats = {(r.last_event_token_id, r.next_event_token_id): (r["count"], r.total_count, r["rank"]) for r in markov.markov_stats(train).collect()}
    assert stats == {(2, 7): (2, 3, 1), (2, 8): (1, 3, 2)}
    pred = markov.predict_markov(df.filter("split = 'test'"), train, 3).collect()
    assert sorted(r.predictions for r in pred) == [[7, 8], [7, 8, 7], [7, 8, 7]]
    f = markov.markov_features(df, markov.markov_stats(train)).filter("event_token_ids[0] = 9").first()
    assert (f.markov_last_total_count, f.markov_top1_prob, f.markov_top10_entropy, f.markov_actual_rank) == (0.0, 0.0, 0.0, None)


def test_rank_metrics(spark):
    df = spark.createDataFrame([("s", 1, 7, [7, 3, 7]), ("s", 1, 3, [7, 3]), ("s", 1, None, [1])], "split string, prefix_len int, next_event_token_id long, predictions array<long>")
    r = metrics.rank_metrics(df, "m", 10).first()
    assert (r.mrr_at_10, r.hit_at_5, r.num_rows) == (0.75, 1.0, 2)


def test_binary_metrics(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, 0.6), ("a", 0, 0.6), ("b", 1, 0.7)]
    out = {r.g: r for r in metrics.binary_metrics(spark.createDataFrame(rows, "g string, label int, prob double"), ["g"]).collect()}
    assert out["a"].roc_auc == 0.875 and out["b"].roc_auc is None and round(out["a"].f1, 6) == 0.8
    assert round(out["a"].pr_auc, 6) == round(0.5 + 0.5 * 2 / 3, 6)
    assert metrics.weighted_mean(spark.createDataFrame([], "v double, w double"), "v", "w").first().mean == 0.0


def test_sequence_and_dense_features(spark):
    r = features.sequence_features(frame(spark), ["user_id"]).filter("repeat_count = 1").first()
    assert (r.unique_event_count, r.repeat_rate, round(r.event_entropy, 6), r.gap_mean, r.gap_std, r.gap_max) == (1, 0.5, 0.0, 0.5, 0.5, 1)
    terms = features.hashed_terms(frame(spark).filter("event_token_ids = array(1L, 2L)")).first().terms
    assert sorted(terms) == ["b=1_2", "last1=2", "last2=1", "u=1", "u=2"]


def test_svd_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = (rng.random((60, 12)) < 0.4) * rng.integers(1, 4, (60, 12)).astype(float)
    cells = [(i, [j for j in range(12) for _ in range(int(row[j]))], [1.0] * int(row.sum())) for i, row in enumerate(x)]
    df = spark.createDataFrame([*cells, (60, [], [])], "k long, idx array<int>, val array<double>")
    out, figures = decompose.truncated_svd(df, ["k"], 3)
    z = np.array([r.embedding for r in out.orderBy("k").collect()])
    u, s, vt = np.linalg.svd(x)
    assert np.allclose(np.linalg.norm(z, axis=0), s[:3], rtol=1e-4) and np.allclose(np.abs(z[:60]), np.abs(x @ vt[:3].T), atol=1e-3) and not z[60].any()
    full = np.vstack([x, np.zeros(12)])
    assert abs(figures.first().explained_ratio - z.var(0).sum() / full.var(0).sum()) < 1e-6


def test_stacked_cells(spark):
    df = features.hashed_terms(frame(spark).filter("event_token_ids = array(1L, 2L)")).withColumn("x", F.lit(2.5)).withColumn("y", F.lit(None).cast("double"))
    r = features.stacked_cells(df, ["user_id"], 64, ("x", "y")).first()
    assert (r.idx[-2:], r.val) == ([64, 65], [1.0] * 5 + [2.5, 0.0]) and all(0 <= i < 64 for i in r.idx[:-2])


def test_canonical_json(spark):
    text = '{" b  key ":{"y":" a\\n b ","x":[1.5,"q\\"uo, te: [\\"]"]},"a":"' + "z" * 81 + '"}'
    assert parsed(spark, text).event_json_canonical == '{"b key":{"x":[1.5,"q\\"uo, te: [\\"]"],"y":"a b"},"a":"' + "z" * 80 + '..."}'
    assert parsed(spark, '[" a "]').event_json_canonical == '{"__root__":["a"]}'


def test_model_inputs_masks_and_views(spark):
    df = frame(spark)
    r = prep.model_inputs(df, 2).filter("user_id is not null").first()
    assert r.input_ids == [3, 1] and r.attention_mask == [1, 1]
    masked = prep.mask_tokens(prep.model_inputs(df, 6), "user_id", 50).collect()
    assert {m.user_id for m in masked if m.label != -100} == {r.user_id for r in df.collect() if set(r.event_token_ids) - {0, 2, 3}}
    assert all(m.label == m.token for m in masked if m.label != -100) and not any(m.label != -100 for m in masked if m.token in (0, 2, 3))
    long = spark.createDataFrame([(str(i), list(range(10, 20)), [1] * 10, [0] * 10) for i in range(40)], "user_id string, event_token_ids array<long>, time_gap_ids array<long>, session_flags array<long>")
    views = prep.augmented_view(long, "user_id", {"mask": 0.2, "crop": 0.4, "reorder": 0.5}, "7").collect()
    assert {v.view_kind for v in views} == {"mask", "crop", "reorder"}
    for v in views:
        ids = v.event_token_ids
        assert {"mask": ids.count(2) == 2, "crop": len(ids) == 6 and ids == list(range(ids[0], ids[0] + 6)), "reorder": sorted(ids) == list(range(10, 20))}[v.view_kind]


def test_pooling(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "token long, vector array<double>")
    r = prep.pooled(frame(spark).filter("event_token_ids = array(1L, 2L)"), "user_id", vectors, "mean+last").first()
    assert r.embedding == [0.5, 1.0, 0.0, 2.0]
    with pytest.raises(ValueError):
        prep.pooled(frame(spark), "user_id", vectors, "max")
    states = spark.createDataFrame([("u", 0, [9.0]), ("u", 1, [1.0]), ("u", 2, [3.0]), ("w", 0, [7.0])], "user_id string, pos int, vector array<double>")
    got = {r.user_id: r.embedding for r in prep.pool_states(states, ["user_id"], "cls+mean+last").collect()}
    assert got == {"u": [9.0, 2.0, 3.0], "w": [7.0, 7.0, 7.0]}


def test_best_by_puts_nan_last(spark):
    df = spark.createDataFrame([("t", "a", float("nan")), ("t", "b", 0.1), ("t", "c", None), ("t", "d", 0.1)], "target string, model_name string, auc double")
    assert report.best_by(df, ["target"], "auc").first().model_name == "b"


def test_csv_ingest(spark, tmp_path):
    (tmp_path / "e.csv").write_bytes("﻿user,name,json,dt,ts,sess,extra\nu1, open ,\"{\"\"k\"\":1}\",2024-01-01 00:00:00,1704067200,NA,x\nu2,,{},2024-01-01,5,s,x\nu3,b,,nope,7,s,x\nu4,c,NULL,2024-01-02 00:00:00,bad,s,x\n".encode())
    names = {"user_id": "user", "event_name": "name", "event_json": "json", "event_datetime": "dt", "event_timestamp": "ts", "session_id": "sess"}
    raw = files.read_raw_csv(spark, str(tmp_path / "e.csv"), list(names.values()))
    clean = files.clean_events(raw, names)
    (r,) = clean.collect()
    assert (r.user_id, r.event_name, r.event_json, r.event_timestamp, r.session_id) == ("u1", "open", '{"k":1}', 1704067200, None)
    audit = files.ingest_audit(raw, clean).first()
    assert (audit.rows_in, audit.rows_out, audit.rows_dropped) == (4, 1, 3)
    with pytest.raises(ValueError):
        files.read_raw_csv(spark, str(tmp_path / "e.csv"), ["absent"])


def test_stream_takes_new_files_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    part = spark.createDataFrame([(1,), (2,)], "x int")
    part.write.parquet(str(src / "a"))
    run = lambda: ingest_new_files(spark, f"{src}/*", part.schema, lambda df: df.filter("x > 1"), out, ck, str(tmp_path / "audit"))
    run()
    run()
    assert spark.read.parquet(out).count() == 1
    part.write.parquet(str(src / "b"))
    run()
    assert spark.read.parquet(out).count() == 2 and spark.read.parquet(str(tmp_path / "audit")).agg(F.sum("rows_in")).first()[0] == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None, 1), ("a", 1, "s", 1), ("a", 1, None, 0)], "user_id string, event_timestamp long, session_id string, event_token_id long")
    assert [r.user_id for r in files.sorted_export(df, 1).collect()] == ["a", "a", "b"]
    files.write_table(df, str(tmp_path / "t"), by=["user_id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    files.write_metrics(df, str(tmp_path / "m"))
    assert files.read_metrics(spark, str(tmp_path / "m"), df.schema).count() == 3


def test_pooled_keeps_unknown_tokens_and_empty_rows(spark):
    df = spark.createDataFrame([("a", [7, 9]), ("b", [9]), ("c", [])], "user_id string, event_token_ids array<long>")
    vectors = spark.createDataFrame([(7, [1.0, 2.0])], "token long, vector array<double>")
    got = lambda v: {r.user_id: r.embedding for r in prep.pooled(df, "user_id", v, "mean+last").collect()}
    assert got(vectors) == {"a": [0.5, 1.0, 0.0, 0.0], "b": [0.0] * 4, "c": [0.0] * 4}
    unk = spark.createDataFrame([(prep.UNK, [3.0, 4.0])], vectors.schema)
    assert got(vectors.union(unk)) == {"a": [2.0, 3.0, 3.0, 4.0], "b": [3.0, 4.0] * 2, "c": [3.0, 4.0] * 2}
