"""A large family of copies near the threshold of each other."""

import random
import tracemalloc

import numpy as np

from skein.llm import bytebpe, ngramjoin, toxicity


def test_members_near_the_threshold_meet_a_pivot_and_not_each_other(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words))]
    for k in range(1, 61):
        own = list(words)
        for at in rng.sample(range(5, 395, 6), 5):
            own[at] = f"x{k}y{at}"
        rows.append((k, " ".join(own)))
    made, real = [], ngramjoin.staged

    def counted(df, name):
        out = real(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(ngramjoin, "staged", counted)
    out = ngramjoin.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(k, 0) for k in range(61)}  # all link with the first only
    assert sum(n for name, n in made if name == "pairs") <= 2 * len(rows)


def test_working_memory_follows_the_chunk_and_not_the_batch():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(300)).encode() for _ in range(1500)]
    keys = np.arange(1, 1000, dtype=np.uint64) << np.uint64(50)
    for work in (lambda: toxicity.terms(texts, keys), lambda: [None for _ in ngramjoin.shingle_sets(texts, 5)]):
        work()
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 24 << 20


def test_digests_remember_merges_of_a_wide_vocabulary(spark, monkeypatch):
    """Merges are done once a word while its generation is remembered; the query's workers remember more than the pipeline's."""
    rng = random.Random(8)
    words = [("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9))).encode() for _ in range(500)]
    texts, merged, merge = [b" ".join(words)] * 3, [], bytebpe.Codec.merge
    monkeypatch.setattr(bytebpe.Codec, "merge", lambda self, piece: merged.append(piece) or merge(self, piece))
    rows = []
    for remembered in (600, 40):
        merged.clear()
        codec = bytebpe.load(None, remembered)
        rows.append([r for t in texts for r in codec.digests([t])])
        rows.append(len(merged))
    assert rows[0] == rows[2] and rows[1] <= 501 < 1000 < rows[3]
    sizes, load = [], bytebpe.load
    monkeypatch.setattr(bytebpe, "load", lambda *a: sizes.append(load(*a).remembered) or load(*a))
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    bytebpe.encode_digests(docs)
    bytebpe.encoded(docs)
    assert sizes == [bytebpe.WIDE_CACHE, bytebpe.CACHE] and sizes[0] > sizes[1]
