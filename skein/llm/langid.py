"""Language ID by segmentation-marginalised unigrams.

The pieces are all entries of a fixed public byte vocabulary, without the space that leads many of
them and ASCII lower-cased (all single bytes are among them).
Each language has a probability for every piece, learned by expectation-maximisation over all
segmentations of the training words.  A word's probability under a language is the sum over all its
segmentations, computed by a forward pass; a text's is the product over its words, times the share
of the language among the labelled rows.  Words are whole runs of letters of any length, ASCII
lower-cased; memory follows ``CHUNK`` or the longest text.

Null text, or text without a letter, is ``und`` with score 0.  Without any labelled row every text is
``und``.  An empty table gives no rows.  Repeated rows give repeated results, ties go to the first language by
name; columns other than id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import read_ranks
from .codepoints import LETTER, characters, sealed
from .labelled import held_out
from .staging import small_batches
from .textbytes import as_bytes, chunks, prefix_hash, span_hash

FOLDS, FOLD = 4, 2
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds of the training sample, by language.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 1 << 14
ROUNDS, SMOOTH = 3, 0.05
#: Words and their bytes in one forward pass; steps between two rescalings of its window.
PASS_WORDS, PASS_BYTES, RESCALE = 1 << 14, 1 << 18, 16
#: Words whose scores a worker remembers.
CACHE = 300_000
UNKNOWN = "und"


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The byte buffer of the texts, byte starts and ends of words, and the number of each word's text."""
    data = sealed(texts)
    at, _, kind = characters(data)
    place = np.append(at, len(data))
    edge = np.flatnonzero(np.diff((kind == LETTER).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    s, e = place[edge[::2]], place[edge[1::2]]
    return data, s, e, np.searchsorted(np.flatnonzero(data == 0xFF), s)


class Pieces:
    """Sorted hashes of the vocabulary's pieces, with a bitmap that drops most other spans."""

    def __init__(self, entries: list[bytes]):
        own = sorted({bytes(e).lstrip(b" ").lower() for e in entries} - {b""})
        self.width = max(map(len, own))
        data = np.frombuffer(b"".join(own), np.uint8)
        ends = np.cumsum([len(e) for e in own])
        self.keys = np.sort(span_hash(prefix_hash(data), np.concatenate([[0], ends[:-1]]), ends))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the spans that are pieces, and their numbers."""
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[i] == h[maybe]
        return maybe[hit], i[hit]

    def lattice(self, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends within the word, words and pieces of all piece spans; words must be sorted by descending length."""
        size, found = e - s, []
        for k in range(1, min(self.width, int(size.max(initial=0))) + 1):
            n = size[: np.searchsorted(-size, -k, "right")] - k + 1
            word = np.repeat(np.arange(len(n)), n)
            start = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
            at, piece = self.find(span_hash(h, s[word] + start, s[word] + start + k))
            found.append((start[at], start[at] + k, word[at], piece))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def steps(place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of spans by place and word; per place, where its spans begin and its first group; where each group begins.

    Single bytes are pieces: at each place the groups are those of the words that reach so far, in order.
    """
    order = np.lexsort((word, place))
    place, word = place[order], word[order]
    group = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (word[1:] != word[:-1])))[: len(place)]
    most = np.arange(int(place.max(initial=-1)) + 2)
    return order, np.searchsorted(place, most), np.searchsorted(place[group], most), group


class Identifier:
    def __init__(self, langs: list[str], prior: np.ndarray, pieces: Pieces, prob: np.ndarray):
        self.langs, self.prior, self.pieces, self.prob = langs, prior, pieces, prob
        self._fresh()

    def _fresh(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)), np.float32)

    def __getstate__(self):
        return self.langs, self.prior, self.pieces, self.prob

    def __setstate__(self, state):
        self.langs, self.prior, self.pieces, self.prob = state
        self._fresh()

    def forward(self, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """log10 probability of each word under each language, summed over segmentations."""
        order = np.argsort(s - e, kind="stable")
        s, e = s[order], e[order]
        start, end, word, piece = self.pieces.lattice(h, s, e)
        by, span, first, group = steps(end, word)
        start, word, piece = start[by], word[by], piece[by]
        wide = self.pieces.width + 1
        alpha = np.ones((wide, len(s), len(self.langs)))  # rows of the last places, by place modulo wide
        scale, out = np.zeros((len(s), len(self.langs))), np.empty((len(s), len(self.langs)), np.float32)
        for t in range(1, int((e - s).max(initial=0)) + 1):
            i, j, live, left = span[t], span[t + 1], first[t + 1] - first[t], first[t + 2] - first[t + 1] if t + 2 < len(first) else 0
            now = np.add.reduceat(alpha[start[i:j] % wide, word[i:j]] * self.prob[piece[i:j]], group[first[t] : first[t + 1]] - i)
            alpha[t % wide, :live] = now
            out[order[left:live]] = np.log10(now[left:]) + scale[left:live]
            if t % RESCALE == 0 and left:
                alpha[:, :left] /= now[:left]
                scale[:left] += np.log10(now[:left])
        return out

    def word_scores(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        h = prefix_hash(data, lower=True)
        keys, first, inverse = np.unique(span_hash(h, s, e), return_index=True, return_inverse=True)
        scores = np.empty((len(keys), len(self.langs)), np.float32)
        i = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[i] == keys if len(self.keys) else np.zeros(len(keys), bool)
        scores[known] = self.values[i[known]]
        new = np.flatnonzero(~known)
        if len(new):
            size = np.cumsum(e[first[new]] - s[first[new]])
            turn = np.maximum(size // PASS_BYTES, np.arange(len(new)) // PASS_WORDS)
            for part in np.split(new, np.flatnonzero(np.diff(turn)) + 1):
                scores[part] = self.forward(h, s[first[part]], e[first[part]])
        if len(self.keys) + len(new) > CACHE:
            self._fresh()
        merged = np.concatenate([self.keys, keys[new]])
        order = np.argsort(merged, kind="stable")
        self.keys, self.values = merged[order], np.concatenate([self.values, scores[new]])[order]
        return scores[inverse]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        pred, score = [], []
        for i, j in chunks(texts):
            data, s, e, doc = words(texts[i:j])
            total = np.zeros((j - i, len(self.langs)))
            if self.langs and len(s):
                per = self.word_scores(data, s, e)
                for k in range(len(self.langs)):
                    total[:, k] = np.bincount(doc, per[:, k], j - i)
            some = np.bincount(doc, minlength=j - i) > 0
            if not self.langs:
                pred += [UNKNOWN] * (j - i)
                score.append(np.zeros(j - i))
                continue
            total += self.prior
            best = total.argmax(1)
            share = 1 / np.power(10.0, np.maximum(total - total.max(1, keepdims=True), -300)).sum(1)
            pred += [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
            score.append(np.where(some, share, 0.0))
        return pred, np.concatenate(score) if score else np.zeros(0)


def _maximised(p: np.ndarray, base: np.ndarray, size: np.ndarray, n: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, forth: tuple, back: tuple) -> np.ndarray:
    """Piece probabilities after ``ROUNDS`` rounds; sums over segmentations are kept as logarithms, so that words may be long."""
    most, word_of = int(size.max()), np.repeat(np.arange(len(size)), size + 1)
    for _ in range(ROUNDS):
        log, alpha, beta = np.log(p), np.zeros(int(size.sum()) + len(size)), np.zeros(int(size.sum()) + len(size))
        for (order, span, first, group), places, into, out, sums in ((forth, range(1, most + 1), start, end, alpha), (back, range(most - 1, -1, -1), end, start, beta)):
            into, out, gain = into[order], out[order], log[piece[order]]
            for t in places:
                i, j = span[t], span[t + 1]
                g = group[first[t] : first[t + 1]]
                sums[out[g]] = np.logaddexp.reduceat(sums[into[i:j]] + gain[i:j], g - i)
        word = word_of[start]
        weight = n[word] * np.exp(alpha[start] + log[piece] + beta[end] - alpha[base[word] + size[word]])
        count = np.bincount(piece, weight, len(p))
        p = (count + SMOOTH) / (count.sum() + SMOOTH * len(p))
    return p


def fit(rows: dict[str, list[str]], shares: dict[str, float], path: str | None = None) -> Identifier:
    """Expectation-maximisation of piece probabilities, one language after the other."""
    pieces = Pieces(read_ranks(path or public_tokenizers.path(VOCABULARY)))
    langs = sorted(rows)
    prob = np.zeros((len(pieces.keys), len(langs)))
    for c, lang in enumerate(langs):
        data, s, e, _ = words([t.encode() for t in rows[lang]])
        h = prefix_hash(data, lower=True)
        _, first, n = np.unique(span_hash(h, s, e), return_index=True, return_counts=True)
        order = np.argsort((s - e)[first], kind="stable")
        s, e, n = s[first[order]], e[first[order]], n[order].astype(float)
        p = np.full(len(pieces.keys), 1e-3)
        if len(s):
            start, end, word, piece = pieces.lattice(h, s, e)
            size = e - s
            base = np.cumsum(size + 1) - size - 1
            p = _maximised(p, base, size, n, start + base[word], end + base[word], piece, steps(end, word), steps(start, word))
        prob[:, c] = p
    return Identifier(langs, np.log10([max(shares[x], 1e-9) for x in langs]) if langs else np.zeros(0), pieces, prob)


def train(docs: DataFrame, path: str | None = None) -> Identifier:
    """Language shares over all labelled rows; texts of a sample bounded by language, in the order of a hash of the id."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(FOLDS, FOLD))
    shares = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    fits = known.filter(F.octet_length("text").between(1, SAMPLE_BYTES)).select("lang", "text", F.xxhash64("doc_id").alias("order"))
    if shares:  # most rows of a frequent language cannot be among the first; only a few times the sample is ranked
        last = {k: min((1 << 63) - 1, (1 << 64) * 4 * SAMPLE_DOCS // n - (1 << 63)) for k, n in shares.items()}
        limits = F.create_map(*[x for k, v in last.items() for x in (F.lit(k), F.lit(v).cast("long"))])
        fits = fits.filter(F.col("order") <= limits[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("order", "text")
    rows = fits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_DOCS).collect()
    by: dict[str, list[str]] = {lang: [] for lang in shares}
    for r in rows:
        by[r.lang].append(r.text)
    total = max(1, sum(shares.values()))
    return fit({k: by[k] for k in shares}, {k: v / total for k, v in shares.items()}, path)


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, path))
    small_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            pred, score = model.predict(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "lang_pred", "score")


def op10_marginal_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
