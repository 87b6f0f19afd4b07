"""Operators of the training-data subpackage against brute force, round trips and held-out accuracy."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from skein.llm import bytebpe, components, curriculum, langid, ngramjoin, oggmedia, quality, spotsigs, suffixdedup, toxicity
from skein.llm.inducedsort import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, hash string, key string, n string"
WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "ti", "su") for b in ("ra", "ne", "lo") for c in ("m", "sh", "")]


def docs_of(spark, rows):
    """(doc_id, text, source) rows with clashing extra columns."""
    full = [(i, t, "en" if t else None, s, len(t or ""), "x", None, "k", "0") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(1, 80)), f"s{i % 3}") for i in range(24)]
    rows += [(30 + i, base if i < 3 else base.replace(base.split()[i], "edited", 1), "s0") for i in range(12)]
    rows += [(60, None, None), (61, "", "s1"), (62, " \n\t ", "s1"), (63, "x", None), (64, "Ünï çødé 日本 " * 30, "s2"), (65, base[:300] + prose(rng, 30), "s2"), (66, prose(rng, 6000), "s1")]
    rows += [rows[0], rows[0]]
    return rows, docs_of(spark, rows).repartition(3).cache()


def test_empty_tables(spark):
    none = docs_of(spark, [])
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        spotsigs.edited_fingerprints(none), oggmedia.media_columns(none), curriculum.mix(none), curriculum.training_order(none), bytebpe.encode_digests(none),
        ngramjoin.near_components(none), suffixdedup.dedup_digests(none), langid.identify(none), toxicity.toxicity(none, no_labels), quality.quality(none, no_labels),
    ):
        assert df.collect() == []


def test_spot_signatures(corpus, spark):
    rows = sorted({(i, t or "") for i, t, _ in corpus[0]})
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(corpus[1].dropDuplicates(["doc_id"])).collect()}
    prints = {}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k, r = len(t) // 4, got[i]
        edited = t[: len(t) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1
        a, b = ({x[j : j + 8] for j in range(0, len(x), 8)} for x in (r.fingerprint, r.edited_fingerprint))
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-6
    pairs = {(r.class_a, r.class_b) for r in spotsigs.near_pairs(corpus[1], 0.8).collect()}
    sets = {i: frozenset(r.fingerprint[j : j + 8] for j in range(0, len(r.fingerprint), 8)) for i, r in got.items()}
    classes = {}
    for i, s in sorted(sets.items()):
        classes.setdefault(s, i)
    want = {frozenset((a, b)) for (s, a), (t, b) in itertools.combinations(classes.items(), 2) if len(s & t) >= 0.8 * len(s | t)}
    assert {frozenset(p) for p in pairs} == want


@pytest.mark.parametrize("n", [64, 4096, 4096 * 9 + 64, 255 * 256, 64 * 5000])
def test_ogg_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = oggmedia.encode(payload)
    back, said = oggmedia.decode(media)
    assert back == payload and said["streams"] == 2 and abs(sum(said["seconds"]) * oggmedia.RATE - n) < 1e-6
    for at in (30, len(media) // 2, len(media) - 1):
        with pytest.raises(ValueError):
            oggmedia.decode(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ValueError):
        oggmedia.decode(media[:-20])


def test_ogg_checksum_by_bits():
    for data in (b"", b"OggS", bytes(range(100))):
        crc = 0
        for x in data:
            crc ^= x << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        assert crc == oggmedia.page_checksum(data)


def test_ogg_long_packets_span_pages():
    packets = [bytes(100_000), b"x" * 255, b""]
    pages = oggmedia.write_stream(packets, [1, 2, 3], 9)
    assert len(pages) > 1 and oggmedia.demux(b"".join(pages))[9]["packets"] == packets


def test_media_columns(corpus):
    for r, t in ((r, {i: t for i, t, _ in corpus[0]}[r.doc_id]) for r in oggmedia.media_columns(corpus[1]).collect()):
        raw = (t or "").encode()
        payload = oggmedia.padded(raw)
        assert len(payload) % 64 == 0 and (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_mix(corpus):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = collections.Counter()
    for _, t, s in corpus[0]:
        sources[s] += size(t)
    rows = curriculum.mix(corpus[1]).collect()
    total, cap = 1.5 * sum(sources.values()), {s: 2.0 * n for s, n in sources.items()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sources, key=lambda s: (s is None, s)))}
    target, open_, left = {}, set(sources), total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= cap[s]}
        if not full:
            target |= share
            break
        target |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    source = {i: s for i, _, s in corpus[0]}
    taken = collections.Counter()
    for r in rows:
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert rows == curriculum.mix(corpus[1]).collect()
    places = [r.position for r in rows if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    ordered = curriculum.training_order(corpus[1])
    assert ordered.columns == corpus[1].columns and ordered.count() > 0


def test_bpe_equals_the_library(corpus):
    codec = bytebpe.load()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bytebpe.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "'", "s", "t", "re", "'s", "'ve", "a", "é", "1", "٣", "!", "　", "\xa0", "\x1c", "日本", "😀", "\r\n", "'d", "ª", "²"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2000)] + ["a" * 4000, "'s", " 's", "\n's", "''s", "<|endoftext|>", " " * 99]
    texts += [t or "" for _, t, _ in corpus[0]]
    every = [flat[a:b].tolist() for _, _, flat, at in codec.encode([t.encode() for t in texts]) for a, b in itertools.pairwise(at)]
    for t, ids in zip(texts, every, strict=True):
        assert ids == library.encode_ordinary(t) and codec.decode(ids) == t.encode()
    text = {i: t or "" for i, t, _ in corpus[0]}
    for r in bytebpe.encode_digests(corpus[1]).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    round_trip = bytebpe.decoded(bytebpe.encoded(corpus[1]))
    assert round_trip.filter(F.coalesce(F.col("text").cast("binary"), F.lit(b"")) != F.col("decoded")).count() == 0


def labelled(spark, n, good, bad):
    rng = random.Random(n)
    rows = [(i, bad(rng) if i % 4 == 0 else good(rng), "s") for i in range(n)]
    return docs_of(spark, rows), rows


def accuracy(df, truth, threshold):
    held = [r for r in df.collect() if r.held_out and r.doc_id in truth]
    assert held and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in held)
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_toxicity_held_out(spark):
    insult = lambda r: f"{prose(r, 20)} {r.choice(['zorg', 'blarg'])} {prose(r, 20)} {r.choice(['zorg!', 'BLARG'])}"
    docs, rows = labelled(spark, 400, lambda r: prose(r, 40), insult)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    assert accuracy(toxicity.toxicity(docs, labels), {i: int(i % 4 == 0) for i, _, _ in rows}, 0.7) > 0.97
    kept = toxicity.kept(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 0.7 * len(rows)
    odd = docs_of(spark, [(1, None, None), (2, "", None), (3, "zorg " * 20000, None)])
    assert len(toxicity.scored(odd, toxicity.train(docs, labels)).collect()) == 3


def test_pairs_beat_sums():
    """An insult counts only together with a group's name: single weights cannot tell, the pair part can."""
    rng = random.Random(1)
    rows = []
    for k in range(900):
        a, b = k % 2, k // 2 % 2
        rows.append((f"{prose(rng, 8)} {'zorg' if a else 'plim'} {'them' if b else 'trees'}", int(a and b)))
    fm = toxicity.fit(rows)
    score = fm.score([t.encode() for t, _ in rows])
    assert min(s for s, (_, y) in zip(score, rows) if y) > max(s for s, (_, y) in zip(score, rows) if not y)


def test_pairs_without_telling_terms():
    """An insult with one group's name or praise with the other's is toxic: each word is as frequent in both classes."""
    rng = random.Random(1)
    rows = []
    for k in range(1200):
        a, b = k % 2, k // 2 % 2
        rows.append((f"{prose(rng, 8)} {'zorg' if a else 'plim'} {'them' if b else 'trees'}", int(a != b)))
    fm = toxicity.fit(rows[:900])
    score = fm.score([t.encode() for t, _ in rows[900:]])
    assert sum((s >= 0.7) == bool(y) for s, (_, y) in zip(score, rows[900:])) >= 295


def test_toxicity_margin_by_brute_force():
    import numpy as np

    rng = random.Random(3)
    fm = toxicity.fit([(f"{prose(rng, 20)} {'zorg blarg' if k % 3 == 0 else 'plim'}", int(k % 3 == 0)) for k in range(300)])
    texts = ["", "zorg", f"zorg zorg {prose(rng, 30)} BLARG", prose(rng, 3000), "zorg", "Ünï blarg"]
    for t, got in zip(texts, fm.score([x.encode() for x in texts]), strict=True):
        at = np.searchsorted(fm.keys, np.unique(toxicity.terms([t.encode()], fm.keys)[0]))
        pairs = sum(float(fm.v[i] @ fm.v[j]) for i, j in itertools.combinations(at.tolist(), 2))
        assert abs(got - 1 / (1 + np.exp(-(fm.w0 + fm.w[at].sum() + pairs)))) < 1e-9


def test_quality_held_out(spark):
    docs, rows = labelled(spark, 300, lambda r: prose(r, 40), lambda r: " ".join(w + "$$$" for w in prose(r, 40).split()))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    assert accuracy(quality.quality(docs, labels), {i: int(i % 4 != 0) for i, _, _ in rows}, 0.3) > 0.95


def test_quality_is_the_same_in_any_batch():
    import numpy as np

    rng = random.Random(5)
    net = quality.fit([(prose(rng, 6) if i % 2 else "ab" * 20, i % 2) for i in range(60)])
    texts = [b"abcabcabcabc", b"abc", b"", b"cabcab", b"a" * 9, b"abcabcab", b"aaaaaaaaaaaaa", b"abcabcabcabc"] + [prose(rng, k).encode() for k in range(1, 8)]
    data, at = quality.laid_out(texts)
    lags = quality.lag_shares(data, at)
    for i, t in enumerate(texts):
        own = t + bytes((at[i + 1] - at[i]) * 8 - len(t))
        want = [[sum(j >= g and own[j] == own[j - g] != 0 for j in range(c * 8, c * 8 + 8)) / 8 for g in quality.LAGS] for c in range(len(own) // 8)]
        assert np.array_equal(lags[at[i] : at[i + 1]], np.array(want, np.float32))
    assert net.score(texts).tolist() == [net.score([t])[0] for t in texts]
    assert len(set(net.score([texts[-1]] * 40 + texts + [texts[-1]]).tolist()[:40])) == 1


def test_quality_network_against_loops():
    import math

    rng = random.Random(6)
    net = quality.fit([(prose(rng, 6) if i % 2 else "ab" * 20, i % 2) for i in range(60)])
    p = net.p
    for t in [b"", b"abcabcab", (prose(rng, 9) + " abcabcabcabcabc").encode()]:
        data = t + bytes(-len(t) % 8 + (8 if t else 16))
        halves = range(len(data) // 8)
        share = lambda h, g: sum(j >= g and data[j] == data[j - g] != 0 for j in range(8 * h, 8 * h + 8)) / 8
        top = []
        for f in range(quality.FILTERS):
            chunks = []
            for h in halves[:-1]:
                total = p["bias"][f]
                for half, weights in ((h, p["first"]), (h + 1, p["second"])):
                    total += sum(p["embed"][data[8 * half + j], e] * weights[j * quality.EMBED + e, f] for j in range(8) for e in range(quality.EMBED))
                    total += sum(share(half, g) * p["lags"][k, f] for k, g in enumerate(quality.LAGS))
                chunks.append(total)
            top.append(max(0.0, *chunks))
        x = p["out_bias"] + sum(a * b for a, b in zip(top, p["out"], strict=True))
        assert abs(net.score([t])[0] - 1 / (1 + math.exp(-x))) < 1e-12


def test_language_held_out(spark):
    rng = random.Random(9)
    speak = {"aa": ["kala", "mala", "tola"], "bb": ["stirk", "blonk", "grend"]}
    rows = [(i, " ".join(rng.choice(speak[s]) + rng.choice("xyz") for _ in range(12)), s) for i, s in enumerate(["aa", "bb"] * 60)]
    df = docs_of(spark, rows).withColumn("lang", F.col("source"))
    df = df.unionByName(docs_of(spark, [(900, None, None), (901, "12 !! €", None), (902, "kalax " * 30000, None)]).withColumn("lang", F.lit(None).cast("string")))
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[i].lang_pred == s for i, _, s in rows)
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred, got[902].lang_pred) == ("und", 0.0, "und", "aa")


def test_forward_sums_all_segmentations():
    import numpy as np

    from skein.llm.textbytes import prefix_hash

    model = langid.fit({"aa": ["abcab cab abc bca"], "bb": ["xyz zyx"]}, {"aa": 0.5, "bb": 0.5})
    pieces = {k: p for k, p in zip(model.pieces.keys.tolist(), model.prob)}
    word = b"abcab"
    data = np.frombuffer(word, np.uint8)

    def brute(i, lang):
        if i == len(word):
            return 1.0
        out = 0.0
        for j in range(i + 1, len(word) + 1):
            h = langid.span_hash(prefix_hash(data, lower=True), np.array([i]), np.array([j]))[0]
            if int(h) in pieces:
                out += pieces[int(h)][lang] * brute(j, lang)
        return out

    got = model.forward(prefix_hash(data, lower=True), np.array([0]), np.array([len(word)]))[0]
    assert np.allclose(10.0**got, [brute(0, 0), brute(0, 1)], rtol=1e-4)


def test_language_takes_whole_words_and_all_pieces():
    import numpy as np

    from skein.llm.textbytes import prefix_hash

    entries = [bytes(e).lstrip(b" ").lower() for e in bytebpe.read_ranks(public_tokenizers.path(langid.VOCABULARY))]
    ru = "действительно правительство человечествоправительства"
    model = langid.fit({"aa": ["understanding " * 3 + "governmentunderstandingresponsibility"], "ru": [ru]}, {"aa": 0.5, "ru": 0.5})
    pieces = {k: p for k, p in zip(model.pieces.keys.tolist(), model.prob)}
    hashed = lambda w: prefix_hash(np.frombuffer(w, np.uint8), lower=True)
    one = lambda w: int(langid.span_hash(hashed(w), np.array([0]), np.array([len(w)]))[0])
    assert all(one(e) in pieces for e in entries if e)
    for word in ("understandinggovernmentresponsibility", ru.split()[2], "правительство" * 40, "x" * 3000):
        w = word.encode()
        data, s, e, _ = langid.words([w])
        assert (s.tolist(), e.tolist()) == ([0], [len(w)])
        log = np.full((len(w) + 1, 2), -np.inf)
        log[0] = 0
        for t in range(1, len(w) + 1):
            hits = [(k, pieces.get(one(w[t - k : t]))) for k in range(1, min(t, model.pieces.width) + 1)]
            log[t] = np.logaddexp.reduce([log[t - k] + np.log(p) for k, p in hits if p is not None])
        assert np.allclose(model.forward(prefix_hash(data, lower=True), s, e)[0], log[-1] / np.log(10), rtol=1e-5)


def shingles(text, width):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_near_components(corpus, width, percent):
    sets = {i: shingles(t, width) for i, t, _ in corpus[0]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = ngramjoin.near_components(corpus[1], width, percent).collect()
    assert len(got) == len(corpus[0])
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id)) for r in got)
    left = {r.doc_id for r in ngramjoin.one_of_each(corpus[1], width, percent).collect()}
    assert left == {i for i in sets if find(i) == i}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_suffix_arrays():
    import numpy as np

    rng = random.Random(2)
    for trial in range(150):
        alphabet = rng.choice([b"a", b"ab", b"abcdefgh", bytes(range(256))])
        b = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) * rng.choice([1, 1, 3])
        t = np.append(np.frombuffer(b, np.uint8).astype(np.int64) + 1, 0)
        sa = suffix_array(t, 258)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        pair = common_prefixes(np.frombuffer(b, np.uint8), sa[1:], 20)
        for x, y in zip(sa[2:].tolist(), sa[1:-1].tolist()):
            k = next((k for k in range(20) if max(x, y) + k >= len(b) or b[x + k] != b[y + k]), 20)
            assert pair[x] == k or (max(x, y) + k >= len(b) and pair[x] >= k)


@pytest.mark.parametrize("hot", [1, 1024])
def test_suffix_dedup(corpus, spark, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    rows = sorted({(i, (t or "").encode()) for i, t, _ in corpus[0]})
    seen, want = set(), {}
    for i, t in rows:
        own = [t[p : p + 50] for p in range(len(t) - 49)]
        gone = {x for p, w in enumerate(own) if w in seen for x in range(p, p + 50)}
        seen.update(own)
        kept = bytes(b for x, b in enumerate(t) if x not in gone)
        want[i] = (len(t), len(gone), sum(1 for x in gone if x - 1 not in gone), hashlib.sha256(kept).hexdigest())
    got = suffixdedup.dedup_digests(corpus[1]).collect()
    assert len(got) == len(corpus[0])
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    cut = suffixdedup.without_repeats(corpus[1])
    assert cut.columns == corpus[1].columns and cut.filter("doc_id = 31").first().text == "" and cut.filter("doc_id = 60").first().text is None


def test_pipeline_keeps_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, prose(rng, 30) if i % 5 else prose(rng, 20) + " zorg blarg", f"s{i % 2}") for i in range(60)]
    docs = docs_of(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(out := str(tmp_path / f"out{stage.__name__}"))
        now = spark.read.parquet(out)
    ids = {r.doc_id for r in now.collect()}
    assert ids and not any(i % 5 == 0 for i in ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).filter("n_tokens > 0").count() == now.count()
