"""Nulls, empty and very long texts, repeated rows, ties and planted groups, against plain Python."""

import collections
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.llm import entry, langid, ngramjoin, quality, spotsigs, suffixdedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, mark string, component string"
WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "ti", "su") for b in ("ra", "ne", "lo") for c in ("m", "sh", "")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en" if t else None, "s", len(t or ""), "x", None, "k", "0") for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def shingles(text, width):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width, percent):
    """Per row: the smallest id (null last) of the rows reachable by links."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k]:
            r = find(k)
            least[r] = i if r not in least or least[r] is None else least[r] if i is None else min(i, least[r])
    return [(i, len(sets[k]), least[find(k)] if sets[k] and least[find(k)] is not None else i) for k, (i, _) in enumerate(rows)]


def edited(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_join_of_a_large_group_and_a_common_passage(spark, monkeypatch, width, percent):
    """Near copies with none to four edits, a passage in unlike texts, one id with two texts, null ids between."""
    rng = random.Random(width)
    base, passage = prose(rng, 150).split(), prose(rng, 55)
    rows = [(100 + k, edited(rng, base, k % 5)) for k in range(60)]
    rows += [(300 + k, f"{passage} {prose(rng, rng.randint(1, 60))}") for k in range(40)]
    rows += [(400 + k, prose(rng, rng.randint(1, 14))) for k in range(40)]
    two = prose(rng, 90).split()
    rows += [(1, " ".join(two)), (1, prose(rng, 70)), (2, edited(rng, two, 1)), (3, rows[-1][1]), (None, edited(rng, two, 1)), (None, None), (4, "")]
    monkeypatch.setattr(ngramjoin, "ROWS_EACH", 0)
    monkeypatch.setattr(ngramjoin, "FREQUENT", 4)
    got = ngramjoin.near_components(docs_of(spark, rows).repartition(5), width, percent).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_components(rows, width, percent))


def test_sketches_bound_the_intersection():
    import numpy as np

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 12, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (1, 3, 9, 40, 41, 300, 700, 3000)]
    n = np.array([len(s) for s in sets])
    packed = ngramjoin.sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), n)
    for x, y in itertools.product(range(len(sets)), repeat=2):
        most = ngramjoin.most_shared([packed[x]], [packed[y]])[0]
        assert len(np.intersect1d(sets[x], sets[y])) <= most and (x != y or most == n[x])


def test_bands_hold_all_partners():
    import numpy as np

    for percent in (80, 90):
        n = np.arange(1, 3000)
        band = ngramjoin.bands(n, percent)
        least = -(-n * percent // 100)
        assert (band - band[np.maximum(least, 1) - 1] <= 1).all() and (np.diff(band) >= 0).all()


def test_one_of_each_keeps_the_other_text_of_an_id(spark):
    rng = random.Random(8)
    words = prose(rng, 60).split()
    rows = [(5, edited(rng, words, 1)), (9, " ".join(words)), (9, prose(rng, 50)), (11, None), (12, " "), (13, "one two"), (13, "one two")]
    left = ngramjoin.one_of_each(docs_of(spark, rows), 5, 80)
    assert left.columns == SCHEMA_COLUMNS
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter([rows[0], *rows[2:]])


SCHEMA_COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]


def test_suffix_dedup_of_repeated_rows(spark):
    rng = random.Random(9)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(1, a), (1, a), (2, f"{b} {a}"), (3, None), (4, ""), (5, "é" * 60 + a), (None, b), (7, a[:49])]
    cut = suffixdedup.without_repeats(docs_of(spark, rows))
    assert cut.columns == SCHEMA_COLUMNS
    got = collections.Counter((r.doc_id, r.text) for r in cut.collect())
    assert got == collections.Counter([(1, a), (1, a), (2, f"{b} "), (3, None), (4, ""), (5, "é" * 60), (None, ""), (7, a[:49])])


def test_equal_rows_score_alike(spark):
    rng = random.Random(2)
    rows = [(i, f"{prose(rng, 30)} {'zorg blarg' if i % 4 == 0 else ''}") for i in range(240)]
    odd = [(900, None), (901, ""), (902, " \n"), (903, "zorg " * 40000), (903, "zorg " * 40000), (904, "Ünï 日本 " * 50), (None, "plain")]
    docs = docs_of(spark, rows + odd)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i, _ in rows] + [(900, 1, 0), (903, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for op, column in ((toxicity.toxicity, "score"), (quality.quality, "score")):
        got = op(docs, labels).collect()
        assert len(got) == len(rows) + len(odd) and all(0 <= r[column] <= 1 and r.predicted in (0, 1) for r in got)
        by = collections.defaultdict(set)
        for r in got:
            by[r.doc_id].add(r[column])
        assert len(by[903]) == 1 and by[900] == by[901]
    tongues = langid.identify(docs.withColumn("lang", F.when(F.col("text").contains("zorg"), "aa").when(F.col("doc_id") < 240, "bb"))).collect()
    assert len(tongues) == len(rows) + len(odd)
    assert {r.lang_pred for r in tongues if r.doc_id in (900, 901, 902)} == {"und"} and len({r.score for r in tongues if r.doc_id == 903}) == 1


def plain_signatures(text):
    """Pairs of unit and next content word after each anchor run, with plain string work."""
    words = re.sub(r"[^\W_]+", lambda m: m[0], text.lower())
    words = [w for w in re.split(r"[\W_]+", words) if w]
    units, run = [], []
    for w in words:
        if w in spotsigs.ANCHORS:
            run.append(w)
        else:
            units.append((spotsigs.CHAIN_MARK.join([*run, ""]) if run else "") + w)
            run = []
    if run:
        units.append(spotsigs.CHAIN_MARK.join(run))
    return units


def test_spot_signatures_by_plain_python(spark):
    rng = random.Random(12)
    texts = ["The cat sat on the mat and the dog was in a big house", "no anchors here", "the of", "Der Hund und die Katze sind im Haus", "", "!!! ???"]
    texts += [" ".join(rng.choice([*WORDS, "the", "of", "und", "les"]) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    got = spotsigs.with_signatures(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "text", "sig").collect()
    content = lambda u: u and u.rsplit(spotsigs.CHAIN_MARK, 1)[-1]
    pairs = {i: list(itertools.pairwise([*plain_signatures(t), None])) for i, t in enumerate(texts)}  # the last chain has no end
    flat = [(i, a, content(b), spotsigs.CHAIN_MARK in a) for i, own in pairs.items() for a, b in own]
    hashed = spark.createDataFrame(flat, "i long, a string, b string, anchored boolean").select("i", F.hash("a", "b").alias("h"), (F.col("anchored") | (F.pmod(F.hash("a"), F.lit(spotsigs.SPARE)) == 0)).alias("spot"))
    spots, every = collections.defaultdict(set), collections.defaultdict(set)
    for r in hashed.collect():
        every[r.i].add(r.h)
        if r.spot:
            spots[r.i].add(r.h)
    for r in got:
        if spots[r.i]:
            assert set(r.sig) == spots[r.i], texts[r.i]
        elif pairs[r.i]:
            assert set(r.sig) == every[r.i], texts[r.i]
        assert r.sig == sorted(set(r.sig)) and r.sig


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    rows = [(i, prose(rng, 30), f"s{i % 6}") for i in range(40)] + [(50, None, "s1"), (51, "", None), (52, " ", "s2"), (53, "word " * 30000, "s3"), (None, prose(rng, 20), None)]
    rows += [rows[0], rows[0], (60, rows[1][1] + " more", "s0"), (61, rows[2][1], "s5")]
    full = [(i, t, "en", s, len(t or ""), "x", None, "k", "0") for i, t, s in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert {1, 2, 3, 53, None} <= ids and not {60, 61} & ids and all(r.n_tokens == len(r.token_ids) for r in got)


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_query_matches_sql(spark, name):
    data = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want = duck.sql(entry.SQL[name])
    got = entry.QUERIES[name](spark, data).select(*want.columns).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want.fetchall())


def test_pipeline_gives_rows_on_given_tables(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.filter("n_tokens > 0").count() > 100
