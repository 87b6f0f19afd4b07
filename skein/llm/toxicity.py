"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), with x_i = 1 for
each distinct term of the text.  The pair part learns interactions, such as an insult together with
a group's name, that no sum of single weights gives.  Terms are runs of letters and digits, lower
case, and their stems of a few bytes, hashed to 64 bits.  Terms whose share of texts differs between
the classes beyond chance have a weight and a vector.  All other terms of at least ``PAIR_DOCS`` texts of
the training sample have a vector only: by themselves they tell nothing, beside others they may.

A null or empty text has no terms and gets sigmoid(w0).  Without labelled rows of both classes the
machine is empty and every score is near 0.  Very long texts are scored whole, in the memory of their
own terms.  An empty table gives no rows.  Repeated rows are scored alike; other columns are ignored by
the digest and carried by ``kept``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, sample
from .staging import small_batches
from .textbytes import ALNUM, as_bytes, chunks, joined, prefix_hash, span_hash, word_spans

FOLDS, FOLD = 3, 1
THRESHOLD = 0.7
#: Bounds of the training sample and of the model.
SAMPLE_DOCS, SAMPLE_BYTES = 6000, 1 << 15
MIN_DOCS, PAIR_DOCS, SIGMAS, MAX_TERMS, RANK = 4, 128, 3.0, 1 << 14, 6
#: Texts whose terms are counted together.
COUNTED = 128
#: Lengths in bytes of the stems that stand beside whole words.
STEMS = (4, 5, 6)
UPDATES, BATCH, RATE, PRIOR = 1500, 64, 0.02, -2.0
DECAY, PAIR_DECAY = 1e-4, 1e-2


def term_spans(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of all terms and the number of the text that holds each: words, then their stems by length."""
    s, e, n = word_spans(data, place, ALNUM)
    doc = np.repeat(np.arange(len(n)), n)
    starts, ends, docs = [s], [e], [doc]
    for size in STEMS:
        longer = e - s > size
        starts.append(s[longer])
        ends.append(s[longer] + size)
        docs.append(doc[longer])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(docs)


def terms(texts: list[bytes], keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct terms of each text; of those in the sorted ``keys`` only, if given."""
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if keys is not None:
        seen = np.zeros(1 << 20, bool)
        seen[(keys >> np.uint64(44)).astype(np.int64)] = True
    for i, j in chunks(texts):
        data, place = joined(texts[i:j])
        s, e, doc = term_spans(data, place)
        h = span_hash(prefix_hash(data, lower=True), s, e)
        if keys is not None:
            maybe = seen[(h >> np.uint64(44)).astype(np.int64)]
            h, doc = h[maybe], doc[maybe]
            known = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
            h, doc = h[known], doc[known]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        hashes.append(h[first])
        docs.append(doc[first] + i)
    return np.concatenate(hashes), np.concatenate(docs)


def parameters(texts: list[bytes], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the terms that have parameters, and which of them have a weight; of too many, the strongest and the most frequent.

    Texts are counted some at a time, as the driver need not hold all their terms.
    """
    parts = []
    for i in range(0, len(texts), COUNTED):
        h, doc = terms(texts[i : i + COUNTED])
        own, inv = np.unique(h, return_inverse=True)
        parts.append((own, np.bincount(inv, y[i : i + COUNTED][doc], len(own)), np.bincount(inv, minlength=len(own))))
    every, hits, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, inv = np.unique(every, return_inverse=True)
    a, n = np.bincount(inv, hits, len(keys)), np.bincount(inv, seen, len(keys))
    share = y.mean()
    z = np.abs(a - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
    z[n < MIN_DOCS] = 0
    telling, common = z >= SIGMAS, n >= PAIR_DOCS
    chosen = np.union1d(*(np.flatnonzero(mask)[np.argsort(-by[mask], kind="stable")[:MAX_TERMS]] for mask, by in ((telling, z), (common, n))))
    return keys[chosen], telling[chosen]


class FactorizationMachine:
    """keys: sorted term hashes; w0, w (terms), v (terms x rank)."""

    def __init__(self, keys: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.keys, self.w0, self.w, self.v = keys, w0, w, v

    def margin(self, rows: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[rows]
        sums = np.stack([np.bincount(doc, v[:, f], n) for f in range(RANK)], 1)
        squares = np.bincount(doc, (v * v).sum(1), n)
        return self.w0 + np.bincount(doc, self.w[rows], n) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(texts), sigmoid(np.array(self.w0)))
        h, doc = terms(texts, self.keys)
        return sigmoid(self.margin(np.searchsorted(self.keys, h), doc, len(texts))[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[str, int]], seed: int = 7) -> FactorizationMachine:
    """Adaptive-gradient training on the log loss, in a fixed order; classes weigh alike."""
    y = np.array([r[1] for r in rows], float)
    if not rows or y.min() == y.max():
        return FactorizationMachine(np.zeros(0, np.uint64), -40.0, np.zeros(0), np.zeros((0, RANK)))
    texts = [r[0].encode() for r in rows]
    keys, telling = parameters(texts, y)
    rng, size = np.random.default_rng(seed), len(keys)
    fm = FactorizationMachine(keys, PRIOR, np.zeros(size), rng.normal(0, 0.01, (size, RANK)))
    if not size:
        return fm
    h, doc = terms(texts, keys)
    own, at = np.searchsorted(keys, h).astype(np.int32), np.searchsorted(doc, np.arange(len(y) + 1))
    del h, doc
    heft = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    gw, gv = np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    for _ in range(-(-UPDATES * BATCH // len(y))):
        order = rng.permutation(len(y))
        for b in range(0, len(y), BATCH):
            docs = order[b : b + BATCH]
            n = at[docs + 1] - at[docs]
            idx = own[np.repeat(at[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            doc = np.repeat(np.arange(len(docs)), n)
            margin, sums = fm.margin(idx, doc, len(docs))
            g = heft[docs] * (sigmoid(margin) - y[docs]) / len(docs)
            single = np.bincount(idx, g[doc], size)
            dw = np.where(telling, single + DECAY * fm.w, 0)
            dv = np.stack([np.bincount(idx, (g * sums[:, f])[doc], size) for f in range(RANK)], 1) - single[:, None] * fm.v + PAIR_DECAY * fm.v
            gw += dw * dw
            gv += dv * dv
            fm.w -= 10 * RATE * dw / np.sqrt(gw)
            fm.v -= RATE * dv / np.sqrt(gv)
            fm.w0 -= RATE * float(g.sum())
    return fm


def scored(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``docs`` with a column toxicity; all other columns as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    name = "toxicity" if "toxicity" not in docs.columns else "toxicity_score"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for batch in batches:
            p = pa.array(fm.score(as_bytes(batch.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, p], names=[*batch.schema.names, name])

    return docs.mapInArrow(work, schema)


def train(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    return fit(sample(docs, labels, "toxic", FOLDS, FOLD, SAMPLE_DOCS, SAMPLE_BYTES))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select(
        "doc_id",
        held_out(FOLDS, FOLD).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the machine, trained on their own labelled rows, rejects."""
    out = scored(docs, train(docs, labels))
    return out.filter(F.col(out.columns[-1]) < THRESHOLD).select(*docs.columns)


def op6_factorization_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
