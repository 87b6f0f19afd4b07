"""Queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from skein.plans import registry

DATA = Path("/root/testdata/sf0.001")
SOME = ["q_s7_split_map", "q_w2_prefixes", "q_w4_train_window", "q_w11_retention", "q_a2_vocab", "q_x7_hash_split", "q_a8_sequence_features", "q_f1_markov_features", "q_m9_markov_predictor", "q_b1_roc_auc", "q_b2_average_precision", "q_x16_parse_payload", "q_d2_mask_tokens", "q_a15_split_gap",
        "q_s1_raw_csv", "q_s2_required_columns", "q_p2_coerced", "q_p3_unparsed_times", "q_p4_canonical_names", "q_p8_metadata_columns", "q_p9_feature_columns", "q_p13_chosen_models", "q_p14_new_labels",
        "q_j6_metadata_of_joined", "q_m7_named_models", "q_x5_canonical_json", "q_x15_props_leaves", "q_f3_feature_hashing", "q_d1_model_inputs", "q_d4_pooled_mean", "q_d4_pooled_cls_last", "q_t2_ordered_metrics"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert got == sorted(repr([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())


def test_every_sql_has_its_query():
    assert set(registry.SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
