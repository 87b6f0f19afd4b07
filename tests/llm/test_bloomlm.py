"""The Bloom-filter language model against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from skein.llm import bloomlm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tail string, row string"


@pytest.mark.parametrize("head", [8, 1 << 20])
def test_base_score_is_exact(spark, monkeypatch, head):
    monkeypatch.setattr(bloomlm, "HEAD", head)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 61), k=rng.randint(0, 40))).capitalize(), None, None, 0, "x", "y") for i in range(120)]
    rows += [(500, None, None, None, 0, "x", "y"), (501, "", None, None, 0, "x", "y"), (502, " \n", None, None, 0, "x", "y"), (503, "W1 unseen " * 5000, None, None, 0, "x", "y"), rows[3]]
    split = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [""]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t, *_ in rows if not out(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    text = {r[0]: r[1] for r in rows}
    got = bloomlm.score(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        own = split(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(own), sum(w in c for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0


def test_model_beats_the_base_on_fixed_pairs(spark):
    rng = random.Random(2)
    pairs = [(f"a{i}", f"b{i}") for i in range(50)]
    rows = [(i, " ".join(f"{a} {b}" for a, b in rng.choices(pairs, k=30)), None, None, 0, "", "") for i in range(150)]
    held = [r for r in bloomlm.score(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out]
    assert held and all(r.score > r.base_score for r in held)


def test_empty_table(spark):
    assert bloomlm.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_filter_gives_levels_back():
    rng = np.random.default_rng(1)
    key, n = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2), rng.integers(1, 5000, 3000)
    buckets, shift, q = 4, 62, bloomlm.level(n)
    parts = [bloomlm.built(key[own], n[own]) for own in ((key >> np.uint64(shift)) == b for b in range(buckets))]
    f = bloomlm.Filter(np.concatenate(parts), np.array([len(x) * 8 for x in parts]), shift)
    found = f.find(key)
    assert (found >= q).all() and (found == q).mean() > 0.99
    assert (f.find(rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) > 0).mean() < 0.02
    for b, bits in enumerate(parts):  # a bucket alone answers as it does among the others
        own = (key >> np.uint64(shift)) == b
        assert (bloomlm.Filter(bits, np.array([len(bits) * 8]), 0).find(key[own]) == found[own]).all()


def test_scores_are_those_of_the_filter_by_either_route(spark, monkeypatch):
    """Broadcast or dealt, the same scores; and they follow the bits, not the counts."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.randrange(1, 40))), None, None, 0, "", "") for i in range(120)] + [(None, "w1 w2", None, None, 0, "", ""), (500, None, None, None, 0, "", ""), (501, "long " * 30_000, None, None, 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(bloomlm, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(bloomlm, "BUCKET_BYTES", 1500)
    whole = sorted(map(repr, bloomlm.score(df).collect()))
    plan = lambda: bloomlm.score(df)._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow [")
    assert plan() == 1
    monkeypatch.setattr(bloomlm, "BROADCAST_BYTES", 0)
    assert plan() == 2
    assert sorted(map(repr, bloomlm.score(df).collect())) == whole
    full = bloomlm.Filter(np.full(8, 255, np.uint8), np.array([64]), 0)
    none = bloomlm.Filter(np.zeros(8, np.uint8), np.array([64]), 0)
    key = np.arange(5, dtype=np.uint64)
    assert (full.find(key) == bloomlm.LEVELS).all() and not none.find(key).any()


def test_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(bloomlm, "BLOCK_BYTES", 64)
    rows = [(i, "a b " * (2000 if i == 3 else 2), None, None, 0, "", "") for i in range(20)]
    got = {r.doc_id: r for r in bloomlm.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3].n_tokens == 4001 and got[3].n_known == 4001 and len(got) == 20


def test_score_uses_all_ngrams(spark):
    """Rare words and pairs seen once count."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(20)), None, None, 0, "", "") for i in range(150)]
    c, two, texts = collections.Counter(), collections.Counter(), 0
    split = lambda t: t.split() + [""]
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w, texts = split(t), texts + 1
            c.update(w)
            two.update(zip([None, *w], w))
    middle = lambda n: (2 ** (n.bit_length() - 1) + 2 ** n.bit_length() - 1) / 2 if n else 0.0
    n, v, want = sum(c.values()), len(c), {}
    for i, t, *_ in rows:
        w, want[i] = split(t), 0.0
        for a, b in zip([None, *w], w):
            h = texts if a is None else middle(c[a])
            trust = bloomlm.MOST_TRUST * h / (h + bloomlm.TRUST)
            want[i] += math.log10(trust * min(middle(two[a, b]), h) / max(h, 1) + (1 - trust) * (middle(c[b]) + 1) / (n + v + 1))
    got = {r.doc_id: r.score for r in bloomlm.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(two[p] == 1 for p in two) > 1000
    # a filter of 12 bits an entry and 4 probes reads 0.65 % of n-grams too high: 0.9935^42 = 0.76 of these texts have none
    assert sum(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want) > 0.6 * len(rows)
