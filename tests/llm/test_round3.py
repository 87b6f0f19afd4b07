"""Word windows, hard negatives and ranked search against plain Python: nulls, ties, repeats, long texts, other columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import labelled, residuegemm, termpipeline, windowdedup

SCHEMA = "doc_id long, text string, row string, removed string, key string, rank string, score string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "r", None, "k", "1", "s") for i, t in rows], SCHEMA).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def prose(rng, n):
    return " ".join(rng.choice("ba ko ti su ra né ło 日本 x y".split()) + str(rng.randrange(30)) for _ in range(n))


# ------------------------------------------------------------------ word windows


def brute_windows(rows, width):
    """Removed places of every row: (smaller id, null last) or further up in the same row."""
    held = collections.defaultdict(list)
    key = lambda i: math.inf if i is None else i
    for r, (i, t) in enumerate(rows):
        w = words(t)
        for a in range(len(w) - width + 1):
            held[tuple(w[a : a + width])].append((key(i), r, a))
    gone = [set() for _ in rows]
    for places in held.values():
        least = min(p[0] for p in places)
        first = {}
        for k, r, a in places:
            if k > least or first.setdefault(r, a) < a:
                gone[r] |= set(range(a, a + width))
    return gone


def window_rows(rng):
    shared, other = prose(rng, 30), prose(rng, 24)
    rows = [(i, f"{prose(rng, rng.randrange(3, 60))} {shared if i % 3 == 0 else ''}\t{other if i % 5 == 0 else ''}\n{prose(rng, 4)}") for i in range(60)]
    whole = prose(rng, 80)
    rows += [(200 + i, whole) for i in range(40)]  # exact copies
    rows += [(7, whole), (7, whole), (7, rows[0][1])]  # one id, several rows
    rows += [(None, whole), (None, None), (None, f"new {whole}"), (300, None), (301, ""), (302, " \n\t"), (303, "one two"), (304, " ".join(words(whole)[:20])), (305, " ".join(words(whole)[:19]))]
    rows += [(400, "again " * 500), (401, f"{other} and {other} and {other}"), (402, " ".join(words(whole))), (-5, whole.upper()), (-6, whole)]
    return rows


def check_windows(spark, rows, width=20):
    got = windowdedup.repeated_windows(docs_of(spark, rows), width).select("row.doc_id", "row.text", "row.removed", "n_words", F.col("removed").alias("spans"), "kept").collect()
    want = sorted(repr((i, t, len(words(t)), sorted(g), " ".join(w for k, w in enumerate(words(t)) if k not in g))) for (i, t), g in zip(rows, brute_windows(rows, width), strict=True))
    assert sorted(repr((r.doc_id, r.text, r.n_words, [k for s in r.spans for k in range(s.start, s.stop)], r.kept)) for r in got) == want
    for r in got:
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_windows_against_brute_force(spark):
    check_windows(spark, window_rows(random.Random(1)))


def test_windows_of_one_crowded_id_are_split(spark, monkeypatch):
    monkeypatch.setattr(windowdedup, "GROUP_BYTES", 512)
    rng = random.Random(2)
    rows = window_rows(rng)
    crowded = [(50, f"{prose(rng, 5)} {rows[60][1]} {prose(rng, 30)}") for _ in range(60)] + [(None, f"{rows[60][1]} {k}") for k in range(60)]
    deal = windowdedup.Deal(docs_of(spark, rows + crowded))
    dealt = deal.docs.groupBy("rank").agg(F.countDistinct("salt").alias("salts"), F.countDistinct("key").alias("ids")).collect()
    assert any(r.salts > 3 for r in dealt) and all(r.ids == 1 for r in dealt if r.salts > 1)
    check_windows(spark, rows + crowded)


def test_windows_of_long_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(windowdedup, "CHUNK", 64)
    rng = random.Random(3)
    long = prose(rng, 3000)
    check_windows(spark, [(1, long), (2, f"x {long} y"), (3, "w" * 5000 + " " + long), (4, " ".join(["w" * 300] * 50))], width=5)


def test_windows_cut_and_empty_table(spark):
    rng = random.Random(4)
    whole = prose(rng, 25)
    rows = [(1, f"a  {whole}"), (2, f"b {whole} c"), (3, None), (4, "x  y")]
    got = windowdedup.without_repeated_windows(docs_of(spark, rows))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert {r.doc_id: r.text for r in got.collect()} == {1: f"a  {whole}", 2: "b c", 3: None, 4: "x  y"}
    assert windowdedup.repeated_windows(docs_of(spark, rows).filter("false")).count() == 0


def test_window_hashes_roll():
    """Equal windows hash alike wherever they stand, and 200,000 different ones differ."""
    text = (" ".join(str(k) for k in range(200_000)) + " 5 6 7 8").encode()
    _, _, one, two = windowdedup.Words([text]).windows(4)
    assert len(np.unique(one)) == len(one) - 1 and one[5] == one[-1] and two[5] == two[-1]


# ------------------------------------------------------------------ hard negatives


def brute_negatives(rows, width=None):
    """rows: (vec_id, label, vector) in the order of ties."""
    live = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: math.inf if i is None else i
    out = []
    for a, (i, lab, v) in enumerate(live):
        if i is None or i % 100:
            continue
        score = lambda o: sum(x * y for x, y in zip(v, o, strict=False))
        ranked = sorted(((-score(o), key(j), b, m) for b, (j, m, o) in enumerate(live) if b != a))
        for s, p, _, _ in [r for r in ranked if r[3] == lab][:5]:
            hits = [r for r in ranked if r[3] != lab and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, p, n, r[1], -s, -r[0]) for n, r in enumerate(hits, 1)]
    return sorted(repr(tuple(None if x == math.inf else x for x in r)) for r in out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, lab, v, "x", 1, 2) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, tile string, block int, anchor int").coalesce(1)


def mined(spark, rows):
    df = residuegemm.quantised(vectors(spark, rows))
    df = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = residuegemm.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()
    return sorted(repr((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)) for r in got)


def vector_rows(seed, n, dim=6):
    rng = random.Random(seed)
    rows = [(100 * i // 4, rng.randrange(3), [rng.gauss(0.2, 0.5) for _ in range(dim)]) for i in range(n)]
    rows += [(50_001 + i, 1, rows[8][2]) for i in range(12)]  # ties
    rows += [(800, 1, rows[0][2]), (800, 1, rows[0][2]), (None, 2, rows[4][2]), (None, 1, rows[8][2]), (900_000, None, rows[0][2]), (900_100, 1, None), (900_200, 1, []), (900_300, 2, [0.5]), (900_400, 0, [None] * dim)]
    rows += [(900_500, 1, [math.nan] * dim), (900_600, 1, [math.inf] + [0.0] * (dim - 1)), (-100, 0, [0.9] * dim), (900_700, 9, [1.0] * (dim + 3))]
    return rows


@pytest.mark.parametrize("dim", [1, 6, 150])
def test_negatives_against_brute_force(spark, dim):
    rows = vector_rows(dim, 90, dim)
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(residuegemm, "TILE_BYTES", 400)
    monkeypatch.setattr(residuegemm, "BLOCK_BYTES", 200)
    monkeypatch.setattr(residuegemm, "SCORES", 4096 * 3)
    rows = vector_rows(3, 70)
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_without_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(101, 1, [1.0]), (102, 2, [1.0])]) == [] and mined(spark, [(100, 1, [1.0])]) == []
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(100, 1, [1e12]), (2, 1, [1.0])])


def test_residues_give_exact_signed_products():
    rng = np.random.default_rng(1)
    for most, dim in ((3, 1), (255, 64), (256, 700), (1 << 20, 130), (1 << 27, 90)):
        a, b = (rng.integers(-most, most, (5, dim), endpoint=True) for _ in range(2))
        a[0], b[0], b[1] = most, most, -most
        primes = residuegemm.moduli(dim * most * most)
        assert all(64 * (p // 2) ** 2 < 1 << 24 for p in primes)
        want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]
        assert residuegemm.Residues(a, primes).scores(residuegemm.Residues(b, primes)).tolist() == want


# ------------------------------------------------------------------ ranked search

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute_search(rows, items, k=10):
    bags = [collections.Counter(terms(t)) for _, t in rows]
    n, every = sum(bool(b) for b in bags), sum(b.total() for b in bags)
    df = collections.Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for r, ((i, _), b) in enumerate(zip(rows, bags, strict=True)):
            m = 100 - 90 + (90 * b.total() * n) // max(1, every)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                found.append((-score, math.inf if i is None else i, r))
        out += [(item, n, None if i == math.inf else i, -s) for n, (s, i, _) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(repr, out))


def search_case(seed, n):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ba", "KO", "né", "日", "x1") for b in range(40)]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    text = lambda m: rng.choice([" ", "-", ", "]).join(rng.choices(vocab, weights, k=m))
    rows = [(i, text(rng.randrange(1, 80))) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[3][1]), (2000, None), (2001, ""), (2002, " -.- "), (2003, "ba0 " * 20_000), (2004, rows[5][1].upper())]
    items = [(i, text(rng.randrange(1, 25))) for i in range(12)] + [(50, None), (51, ""), (52, "nosuchterm"), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (53, "BA0 ba0 né1")]
    return rows, items


def found(spark, rows, items, **more):
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, terms string, block int")
    return sorted(repr((r.item_id, r.rank, r.doc_id, r.score)) for r in termpipeline.search(docs_of(spark, rows), bench, **more).collect())


def test_search_against_brute_force(spark):
    rows, items = search_case(1, 150)
    assert found(spark, rows, items) == brute_search(rows, items)


def test_search_in_small_pieces(spark, monkeypatch):
    """Many shards, slices and blocks, more owners than usual, texts read in pieces: the same results."""
    for name, value in (("PIECE", 50), ("ITEM_BYTES", 600), ("ITEMS", 3), ("SHARD", 5)):
        monkeypatch.setattr(termpipeline, name, value)
    rows, items = search_case(2, 90)
    assert found(spark, rows, items, owners=7, k=4) == brute_search(rows, items, 4)


def test_search_drops_documents_on_the_way(spark):
    """Bundles leave out what can no longer win, and lose nothing by it."""
    rng = random.Random(5)
    rows = [(i, " ".join(["the", "of"] + [f"rare{i % 50}"] * (1 + rng.randrange(4)) + ["a"] * rng.randrange(30))) for i in range(400)]
    held = termpipeline.postings(docs_of(spark, rows), {b"a": 0, b"of": 1, b"rare7": 2, b"the": 3})
    model = termpipeline.Model(held, 4, 2)
    assert model.owner.tolist() == [0, 0, 0, 1]
    posts = termpipeline.owned(held, model, 0).withColumn("shard", F.lit(0)).withColumn("slice", F.lit(0)).toArrow()
    none = spark.createDataFrame([], termpipeline.BUNDLES).toArrow()
    bundle = termpipeline.add(none, posts, [(0, np.arange(4))], model, 0, 3).to_pylist()[0]
    assert len(posts) == 400 and 3 <= len(bundle["rows"]) <= 8
    assert found(spark, rows, [(1, "the of rare7 a")], k=3) == brute_search(rows, [(1, "the of rare7 a")], 3)


def test_search_of_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_query_digests(spark, tmp_path):
    rng = random.Random(8)
    rows = window_rows(rng)
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = windowdedup.op12_rabin_karp_windows(spark, str(tmp_path)).collect()
    want = [(i, len(words(t)), len(g), hashlib.sha256(" ".join(w for k, w in enumerate(words(t)) if k not in g).encode()).hexdigest()) for (i, t), g in zip(rows, brute_windows(rows, 20), strict=True)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got)


# ------------------------------------------------------------------ pieces read inside workers


def test_words_and_terms_in_small_pieces(monkeypatch):
    """What a worker reads in pieces is the same whatever the pieces' size."""
    rng = random.Random(9)
    texts = [prose(rng, n).encode() for n in (0, 1, 300)] + [b"x" * 700 + b" y", b"", "né é".encode() * 40]
    whole, counts = windowdedup.Words(texts), [termpipeline.term_counts(t) for t in texts]
    monkeypatch.setattr(windowdedup, "CHUNK", 16)
    monkeypatch.setattr(termpipeline, "PIECE", 7)
    pieces = windowdedup.Words(texts)
    assert (whole.value == pieces.value).all() and whole.count.tolist() == [len(words(t.decode())) for t in texts]
    assert [termpipeline.term_counts(t) for t in texts] == counts == [collections.Counter(x.encode() for x in terms(t.decode())) for t in texts]


def test_sample_is_bounded_in_rows(spark):
    """An id of very many rows does not lift the bound of a training sample."""
    docs = docs_of(spark, [(1, f"same {k}") for k in range(300)] + [(k, f"text {k}") for k in range(2, 120)])
    marks = spark.createDataFrame([(k, k % 2) for k in range(1, 120)], "doc_id long, toxic int")
    rows = labelled.sample(docs, marks, "toxic", 3, 1, 40, 1000)
    again = labelled.sample(docs.repartition(7), marks, "toxic", 3, 1, 40, 1000)
    assert rows == again and len(rows) <= 40 and all(sum(y == v for _, y in rows) <= 20 for v in (0, 1))
    every = labelled.sample(docs, marks, "toxic", 3, 1, 10_000, 1000)
    assert len(every) > 300
