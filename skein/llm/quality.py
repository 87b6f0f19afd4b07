"""Quality by a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of ``2 * HALF`` bytes that overlap by half and cover the whole
text.  Each chunk is seen as learned embeddings of its bytes at their places, plus the share of its
bytes that equal the byte some lags earlier (so that runs of one word show).  Learned filters over a
chunk, rectified, are max-pooled over the text and combined into one probability.

A null or empty text is one chunk of padding, a score like any other.  Without labelled rows of both
classes every score is 0.5.  Equal texts have equal scores in any batch; other columns are ignored; an empty table gives no rows.  Memory
follows ``CHUNK`` or the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .staging import small_batches
from .textbytes import as_bytes, chunks

FOLDS, FOLD = 5, 0
THRESHOLD = 0.3
HALF, EMBED, FILTERS = 8, 6, 24
#: Distances at which a byte is compared with an earlier one.
LAGS = tuple(range(1, 25))
#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 1 << 14
UPDATES, BATCH, RATE, DECAY = 600, 48, 0.004, 1e-4
PARTS = ("embed", "first", "second", "lags", "bias", "out", "out_bias")


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with 0 bytes to whole half-chunks, plus one; and the first half-chunk of each (n + 1 values)."""
    parts = [t + bytes(-len(t) % HALF + (HALF if t else 2 * HALF)) for t in texts]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p) // HALF for p in parts], out=at[1:])
    return np.frombuffer(b"".join(parts), np.uint8), at


def lag_shares(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per half-chunk and lag, the share of bytes that equal the byte so far before them in the same text."""
    out = np.zeros((len(data) // HALF, len(LAGS)), np.float32)
    same = np.zeros(len(data), np.uint8)
    early = at[:-1, None] * HALF + np.arange(max(LAGS))  # bytes without one so far before them, for lags beyond their column
    for k, lag in enumerate(LAGS):
        same[:lag] = 0
        same[lag:] = (data[lag:] == data[:-lag]) & (data[lag:] != 0) if lag < len(data) else 0
        same[np.minimum(early[:, :lag], len(data) - 1)] = 0  # at the end of the buffer this meets padding only
        words = same.view(np.uint64)  # HALF is 8: one word a half-chunk
        out[:, k] = ((words * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.float32) / HALF
    return out


class ByteNetwork:
    def __init__(self, parts: dict[str, np.ndarray]):
        self.p = parts

    def pooled(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Filter values by chunk, their maxima by text, and the inputs of both kinds by half-chunk."""
        p = self.p
        x = p["embed"][data].reshape(len(data) // HALF, HALF * EMBED)
        lags = lag_shares(data, at)
        y = x @ p["first"] + lags @ p["lags"]
        y[:-1] += (x @ p["second"] + lags @ p["lags"])[1:]
        y += p["bias"]
        y[at[1:] - 1] = -1e9  # the last half-chunk of a text only ends a chunk
        return y, np.maximum(np.maximum.reduceat(y, at[:-1], axis=0), 0), x, lags

    def exact(self) -> ByteNetwork:
        """Weights in float64 on a grid, so coarse that every sum of products in ``pooled`` is exact.

        Then no order of summing, and so no batch that a text shares, changes its score.
        """
        grid = {"embed": 2.0**16, "first": 2.0**20, "second": 2.0**20, "lags": 2.0**20, "bias": 2.0**20}
        return ByteNetwork({k: np.rint(np.clip(v.astype(np.float64), -32, 32) * grid[k]) / grid[k] if k in grid else v.astype(np.float64) for k, v in self.p.items()})

    def score(self, texts: list[bytes]) -> np.ndarray:
        out: list[float] = []
        for i, j in chunks(texts, 1 << 19):
            _, top, _, _ = self.pooled(*laid_out(texts[i:j]))
            total = np.full(len(top), self.p["out_bias"])
            for f in range(FILTERS):
                total += top[:, f] * self.p["out"][f]
            out += [1 / (1 + math.exp(-min(40.0, max(-40.0, x)))) for x in total.tolist()]
        return np.array(out, float)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fresh(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f32 = np.float32
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(f32),
        "first": rng.normal(0, 0.2, (HALF * EMBED, FILTERS)).astype(f32),
        "second": rng.normal(0, 0.2, (HALF * EMBED, FILTERS)).astype(f32),
        "lags": rng.normal(0, 0.2, (len(LAGS), FILTERS)).astype(f32),
        "bias": np.zeros(FILTERS, f32),
        "out": np.zeros(FILTERS, f32),
        "out_bias": np.zeros((), f32),
    }


def fit(rows: list[tuple[str, int]], seed: int = 11) -> ByteNetwork:
    """Adam on the log loss, classes weighing alike; the maximum sends its gradient to one chunk."""
    net = ByteNetwork(fresh(seed))
    y = np.array([r[1] for r in rows], np.float32)
    if not rows or y.min() == y.max():
        return net.exact()
    texts, p, rng = [r[0].encode() for r in rows], net.p, np.random.default_rng(seed)
    heft = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    p["out"][:] = rng.normal(0, 0.3, FILTERS)
    m, v, step = {k: np.zeros_like(p[k]) for k in PARTS}, {k: np.zeros_like(p[k]) for k in PARTS}, 0
    for _ in range(-(-UPDATES * BATCH // len(y))):
        order = rng.permutation(len(y))
        for b in range(0, len(y), BATCH):
            docs = order[b : b + BATCH]
            data, at = laid_out([texts[d] for d in docs])
            value, top, x, lags = net.pooled(data, at)
            g = heft[docs] * (sigmoid(top @ p["out"] + p["out_bias"]) - y[docs]) / len(docs)
            gtop = np.outer(g, p["out"]) * (top > 0)
            doc, filt = np.nonzero(gtop)
            doc_of = np.repeat(np.arange(len(docs)), np.diff(at))
            where = np.zeros((len(docs), FILTERS), np.int64)
            hit, f = np.nonzero(value == top[doc_of])  # the first maximum of each text and filter
            where[doc_of[hit][::-1], f[::-1]] = hit[::-1]
            w, gv = where[doc, filt], gtop[doc, filt].astype(np.float32)
            one = np.zeros((len(w), FILTERS), np.float32)
            one[np.arange(len(w)), filt] = gv
            grad = {
                "first": x[w].T @ one,
                "second": x[w + 1].T @ one,
                "lags": (lags[w] + lags[w + 1]).T @ one,
                "bias": one.sum(0),
                "out": top.T @ g,
                "out_bias": g.sum(),
                "embed": np.zeros((256, EMBED), np.float32),
            }
            halves = data.reshape(-1, HALF)
            for offset, part in ((0, "first"), (1, "second")):
                back = (gv[:, None] * p[part].T[filt]).reshape(-1, EMBED)
                np.add.at(grad["embed"], halves[w + offset].reshape(-1), back)
            step += 1
            for k in PARTS:
                d = grad[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net.exact()


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(sample(docs, labels, "quality", FOLDS, FOLD, SAMPLE_DOCS, SAMPLE_BYTES)))
    small_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(as_bytes(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
    return out.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_byte_conv_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
