"""The mix of sources against the contract's own procedure, step by step."""

import collections
import random
import re

import pytest

from skein.llm import curriculum

SCHEMA = "doc_id long, text string, source string, size string, rank string, position string"


def reshared(sizes, budget=1.5, most=2.0):
    """Targets by sharing the budget, stopping what is above and sharing the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, excess = dict.fromkeys(order, 0.0), set(order), budget * sum(sizes.values())
    while excess > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / total
        excess = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def rows_of(count, skew, rng):
    rows = []
    for k in range(count):
        source = None if k == count - 1 and count > 1 else f"s{k:02d}"
        for _ in range(3):
            rows.append((len(rows), " ".join(["w"] * (rng.randint(1, 40) * (1 + skew * k * k))), source, "a", "b", "c"))
    rows += [(900, None, "s00", "a", "b", "c"), (901, " \n", "s00", "a", "b", "c"), rows[0], rows[0], (None, "x y", "s00", "a", "b", "c")]
    return rows


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 20])
@pytest.mark.parametrize("skew", [0, 1])
def test_targets(spark, count, skew):
    rows = rows_of(count, skew, random.Random(count))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, s, *_ in rows:
        sizes[s] += words(t)
    want, source = reshared(sizes), {i: s for i, _, s, *_ in rows}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, taken = curriculum.mix(docs).collect(), collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    again = curriculum.mix(docs.repartition(2)).collect()
    key = lambda r: (str(r.position), str(r.doc_id), r.size, r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and [key(r)[:2] for r in got] == [key(r)[:2] for r in again]


def test_one_id_with_two_texts_and_repeated_rows(spark):
    rows = [(1, "a b c", "s", "", "", ""), (1, "d e f g h", "s", "", "", ""), (2, "x", "s", "", "", ""), (2, "x", "s", "", "", ""), (2, "x", "s", "", "", ""), (3, None, None, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    ordered = curriculum.training_order(docs)
    assert ordered.columns == docs.columns
    copies = collections.Counter((r.doc_id, r.text) for r in ordered.collect())
    plan = collections.Counter()
    for r in curriculum.plan_mix(docs, whole=True).collect():
        plan[r.doc_id, r.size] += r.copies
    assert all(copies[i, t] == plan[i, len(t.split())] for i, t in {(i, t) for i, t, *_ in rows if t}) and (3, None) not in copies


def test_no_rows_and_no_words(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert curriculum.mix(none).collect() == [] and curriculum.training_order(none).collect() == []
    blank = spark.createDataFrame([(1, " ", "s", "", "", ""), (2, None, None, "", "", "")], SCHEMA)
    assert all((r.target, r.taken, r.position) == (0.0, 0, None) for r in curriculum.mix(blank).collect())
