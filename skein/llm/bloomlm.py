"""Language-model scoring with a log-frequency Bloom filter.

Counts of all words and word pairs of the training texts are gathered exactly, by hash.  A count c goes
into the filter as q = 1 + floor(log2 c) entries (n-gram, 1..q); a reader probes 1, 2, ... until one
is absent and so finds q again.  The filter is the model: a table of parts, one a bucket (the first bits of
the hash), sized by their entries, so that it grows with the input.  Texts are dealt into blocks; each block sends
its distinct n-grams with their counts to their buckets, and each bucket adds the counts up and builds its part.
Scores come from probes of these bits alone.  A filter that is sure to stay below ``BROADCAST_BYTES`` is broadcast to
the scorers; a larger one stays where it is, and each part is probed with the n-grams that blocks sent to its bucket.
The bits, and so the scores, are the same either way.  A block and a bucket without a common n-gram exchange
nothing, so there are never more rows between them than n-grams.  A token's probability is the pair estimate,
interpolated with the word estimate (add one) by how often its history was seen.

The base score needs exact word counts, which the buckets send along, and their number and sum, which
one grouped count gives before.  A text is its words, ASCII
lower-cased, and one end token; null and empty texts are the end token alone.  Without training rows
all counts are 0.  Repeated rows count as often as they occur.  Words are told apart by 64-bit hashes.
An empty table gives no rows; a very long text is one row of its block; columns other than id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out
from .staging import small_batches
from .textbytes import as_bytes, chunks, from_planes, from_rising, joined, mixed, planes, prefix_hash, rising, span_hash, word_spans

FOLDS, FOLD = 7, 2
END, BEGIN = np.uint64(0x5EED5EED5EED0001), np.uint64(0x5EED5EED5EED0002)
#: Text bytes for one bucket of counts, a power of two of them; for one block of texts; and for those of one task.
BUCKET_BYTES, BLOCK_BYTES, TASK_BYTES = 8 << 20, 8 << 20, 24 << 20
#: N-grams of a bucket that are probed at once.
HEAD = 1 << 20
BITS_EACH, PROBES = 12, 4
LEVELS = 32
#: Up to this size the whole filter is broadcast to the scorers; a larger one stays dealt by bucket.
BROADCAST_BYTES = 48 << 20
#: A history seen c times gives its pairs the weight ``MOST_TRUST`` * c / (c + ``TRUST``).
MOST_TRUST, TRUST = 0.25, 10.0


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in order, each text closed by the end token, and the number of each token's text."""
    data, at = joined(texts)
    s, e, n = word_spans(data, at)
    h = span_hash(prefix_hash(data, lower=True), s, e)
    out = np.full(len(h) + len(texts), END, np.uint64)
    doc = np.repeat(np.arange(len(texts)), n + 1)
    ends = np.cumsum(n + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = h
    return out, doc


def pairs(token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token with the one before it, and the history itself; a text begins after BEGIN."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    first = np.ones(len(token), bool)
    first[1:] = doc[1:] != doc[:-1]
    before[first] = BEGIN
    return mixed(mixed(before) * np.uint64(0x9E3779B97F4A7C15) + token), before


def level(count: np.ndarray) -> np.ndarray:
    """q of a count."""
    return np.frexp(count.astype(np.float64))[1]


def count_of(q: np.ndarray) -> np.ndarray:
    """The middle of the counts that share q; 0 for q = 0."""
    return np.where(q > 0, (np.exp2(q - 1.0) + np.exp2(q * 1.0) - 1) / 2, 0.0)


class Filter:
    """The stored model: the bits of some buckets one after the other; an n-gram's bits lie in its bucket.

    ``sizes`` are the bits of each bucket, multiples of 64, ``shift`` gives an n-gram's bucket by its first bits.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, shift: int):
        self.bits, self.sizes, self.shift = bits, sizes.astype(np.uint64), np.uint64(shift)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def places(key: np.ndarray, q: int, probe: int, size: np.ndarray | np.uint64) -> np.ndarray:
        return mixed(key + np.uint64((q * 8 + probe) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % size

    def find(self, key: np.ndarray) -> np.ndarray:
        """q of each n-gram: probes go on until one is absent."""
        out = np.zeros(len(key), np.int64)
        live, k = np.arange(len(key)), key
        own = (key >> self.shift).astype(np.int64) if len(self.sizes) > 1 else np.zeros(len(key), np.int64)
        for q in range(1, LEVELS + 1):
            for probe in range(PROBES):
                at = self.starts[own] + self.places(k, q, probe, self.sizes[own])
                hit = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                live, k, own = live[hit], k[hit], own[hit]
            if not len(live):
                break
            out[live] = q
        return out


def built(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Packed bits of one bucket, of all its n-grams with their counts."""
    q = level(n)
    size = max(64, -(-int(q.sum()) * BITS_EACH // 64) * 64)
    own = np.zeros(size, bool)
    for x in range(1, int(q.max(initial=0)) + 1):
        for probe in range(PROBES):
            own[Filter.places(key[q >= x], x, probe, np.uint64(size)).astype(np.int64)] = True
    return np.packbits(own, bitorder="little")


def _block_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token, number of its text, pair and history of all tokens of a block."""
    parts = []
    for i, j in chunks(texts):
        token, doc = tokens(texts[i:j])
        parts.append((token, doc + i, *pairs(token, doc)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_SENT = "block int, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"
_ANSWER = "block int, bucket int, words binary, exact binary, pairs binary"
_MODEL = "bucket int, bits binary"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _table(columns: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _sender(buckets: int):
    """Distinct n-grams of a block with their counts in training texts (0 if in none), one row a bucket."""
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def send(block: pa.Table) -> pa.Table:
        token, doc, pair, _ = _block_tokens(as_bytes(block.column("text")))
        train, columns = block.column("train").to_numpy()[doc], []
        for ngram in (token, pair):
            keys, inv = np.unique(ngram, return_inverse=True)
            n = np.bincount(inv[train], minlength=len(keys)).astype(np.int32)
            at = np.searchsorted((keys >> shift).astype(np.int64), np.arange(buckets + 1))
            columns += [[pack(x[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)] for x, pack in ((keys, rising), (n, planes))]
        some = [b for b in range(buckets) if columns[0][b] or columns[2][b]]
        return _table([np.full(len(some), block.column("block")[0].as_py()), some, *[[c[b] for b in some] for c in columns]], _SENT)

    return send


def _added(rows: pa.Table, ngrams: str, numbers: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a bucket with their counts, the number of each n-gram sent, and where each row's begin."""
    parts = [from_rising(b) for b in rows.column(ngrams).to_pylist()]
    keys, inv = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.bincount(inv, np.concatenate([from_planes(b, np.int32) for b in rows.column(numbers).to_pylist()]), len(keys)).astype(np.int64)
    return keys, n, inv, np.append(0, np.cumsum([len(x) for x in parts]))


def _shard(rows: pa.Table) -> pa.Table:
    """The filter's part for one bucket: counts of all blocks added up and put in, words and pairs together."""
    word, n_word, _, _ = _added(rows, "words", "word_counts")
    pair, n_pair, _, _ = _added(rows, "pairs", "pair_counts")
    key, n = np.concatenate([word, pair]), np.concatenate([n_word, n_pair])
    return _table([rows.column("bucket").to_numpy()[:1], [built(key[n > 0], n[n > 0]).tobytes()]], _MODEL)


def _answer(rows: pa.Table, shard: pa.Table) -> pa.Table:
    """q of each n-gram that a block sent, probed in this bucket's part of the filter; and exact counts of words, for the base."""
    bits = np.frombuffer(shard.column("bits")[0].as_py(), np.uint8)
    held = Filter(bits, np.array([len(bits) * 8]), 0)
    columns = []
    word, n, inv, at = _added(rows, "words", "word_counts")
    pair, _, pair_inv, pair_at = _added(rows, "pairs", "pair_counts")
    probed = lambda keys: np.concatenate([np.zeros(0, np.int64), *[held.find(keys[i : i + HEAD]) for i in range(0, len(keys), HEAD)]]).astype(np.uint8)
    for x, own, ends in ((probed(word), inv, at), (n, inv, at), (probed(pair), pair_inv, pair_at)):
        columns.append([planes(x[own[i:j]]) for i, j in zip(ends[:-1], ends[1:], strict=True)])
    return _table([rows.column("block").to_numpy(), rows.column("bucket").to_numpy(), *columns], _ANSWER)


def _exact_only(rows: pa.Table) -> pa.Table:
    """Exact counts of the words that a block sent, where scorers hold the whole filter."""
    _, n, inv, at = _added(rows, "words", "word_counts")
    columns = [planes(n[inv[i:j]]) for i, j in zip(at[:-1], at[1:], strict=True)]
    none = [b""] * len(columns)
    return _table([rows.column("block").to_numpy(), rows.column("bucket").to_numpy(), none, columns, none], _ANSWER)


def _scorer(words: int, total: int, whole=None):
    """Scores of a block's texts, given the number of distinct words and of all tokens of the training texts.

    Levels come from probes of the filter: of ``whole``, the broadcast one, or of the buckets' parts as ``answers`` tell.
    """

    def score_block(block: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        texts = as_bytes(block.column("text"))
        token, doc, pair, before = _block_tokens(texts)
        got = lambda c, kind: np.concatenate([from_planes(b, kind) for b in answers.column(c).to_pylist()])
        each, inv = np.unique(token, return_inverse=True)
        every, pair_inv = np.unique(pair, return_inverse=True)
        probe = lambda c, keys: whole.value.find(keys) if whole else got(c, np.uint8).astype(np.int64)
        seen, exact = count_of(probe("words", each)), got("exact", np.int64)
        history = np.empty(len(token))
        history[1:] = seen[inv[:-1]]
        history[before == BEGIN] = exact[np.searchsorted(each, END)]  # as many ends as training texts
        both = count_of(probe("pairs", every))[pair_inv]
        both = np.minimum(both, history)
        trust = MOST_TRUST * history / (history + TRUST)
        p = trust * both / np.maximum(history, 1) + (1 - trust) * (seen[inv] + 1) / (total + words + 1)
        n = len(texts)
        n_tokens, n_known = np.bincount(doc, minlength=n), np.bincount(doc, (exact > 0)[inv], n).astype(np.int64)
        base = np.bincount(doc, np.log10(exact + 1.0)[inv], n) - n_tokens * np.log10(total + words + 1)
        return _table([block.column("doc_id").combine_chunks(), ~block.column("train").to_numpy(), n_tokens, n_known, np.full(n, total), base, np.bincount(doc, np.log10(p), n)], _OUT)

    return score_block


def training_totals(rows: DataFrame) -> tuple[int, int]:
    """Distinct tokens and all tokens of the training texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for i, j in chunks(texts):
                keys, n = np.unique(tokens(texts[i:j])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "n"])

    each = rows.filter("train").select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = each.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    return found.words, found.total


def broadcast_filter(shards: DataFrame, buckets: int):
    """The whole filter, broadcast to the workers."""
    found = {r.bucket: r.bits for r in shards.collect()}
    parts = [np.frombuffer(found[b], np.uint8) if b in found else np.zeros(8, np.uint8) for b in range(buckets)]
    return shards.sparkSession.sparkContext.broadcast(Filter(np.concatenate(parts), np.array([len(x) * 8 for x in parts]), 64 - buckets.bit_length() + 1))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out(FOLDS, FOLD)).alias("train"))
    found = docs.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).first()
    size = found["size"] or 0
    buckets = 1 << max(4, int(size // BUCKET_BYTES).bit_length())
    blocks, tasks = max(16, -(-int(size) // BLOCK_BYTES)), max(16, -(-int(size) // TASK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    dealt = rows.select(block, "doc_id", "text", "train").repartition(tasks, "block")
    sent = dealt.groupBy("block").applyInArrow(_sender(buckets), _SENT).repartition(tasks, "bucket")
    shards = sent.groupBy("bucket").applyInArrow(_shard, _MODEL)
    # each token adds at most one entry for itself and one for its pair
    if (size + 2 * found.n) * BITS_EACH // 8 <= BROADCAST_BYTES:
        whole = broadcast_filter(shards, buckets)
        answers = sent.groupBy("bucket").applyInArrow(_exact_only, _ANSWER)
    else:
        whole = None
        model = shards.select(*[F.col(c).alias(c) for c in shards.columns]).repartition(tasks, "bucket")
        answers = sent.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(_answer, _ANSWER)
    scorer = _scorer(*training_totals(rows), whole)
    return dealt.groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(scorer, _OUT)


def op7_log_bloom_lm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
