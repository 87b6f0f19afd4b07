"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens that are entries
themselves.  Tier two: any other pre-token is merged by a heap of ranked pairs over linked bytes.
Pre-tokens are cut by numpy on the character classes of many texts at once; they follow the public
pattern (contractions, letters, numbers, signs, each with a leading space; white space).

Null text is empty and has no tokens.  A pre-token of any length is merged in n log n steps.
Repeated rows give repeated results; an empty table gives none; other columns are ignored by the
digests and carried by ``encoded``, whose own columns replace others of their names.  Memory follows
``CHUNK`` or the longest text, and the cache of merged pre-tokens is bounded by twice ``CACHE`` or ``WIDE_CACHE``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .codepoints import END, LETTER, OTHER_SPACE, SIGN, SPACE, characters, sealed
from .staging import small_batches
from .textbytes import CHUNK, as_bytes, chunks, mixed, prefix_hash, span_hash

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose merges a worker remembers, in each of two generations: beside whole documents with their ids, and
#: where only digests leave the worker, which has the memory for more of them.
CACHE, WIDE_CACHE = 60_000, 240_000


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    entries = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    return [entries[i] for i in range(len(entries))]


class PerfectHash:
    """Hash and displace: n keys in n slots.  A bucket's seed sends all its keys to free slots."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.seeds = np.zeros(max(1, n), np.uint64)
        self.keys, self.slots = np.zeros(n, np.uint64), n
        bucket = (keys % np.uint64(len(self.seeds))).astype(np.int64)
        order, sizes = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=len(self.seeds))
        first = np.cumsum(sizes) - sizes
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
            own = keys[order[first[b] : first[b] + sizes[b]]]
            for seed in range(1, 1 << 31):
                slot = self._slot(own, np.array(seed, np.uint64))
                if free[slot].all() and len(set(slot.tolist())) == len(own):
                    break
            self.seeds[b] = seed
            free[slot] = False
            self.keys[slot] = own
        alone = np.flatnonzero(sizes == 1)  # buckets of one key point at the slots that are left
        slot = np.flatnonzero(free)
        self.seeds[alone] = np.uint64(1 << 32) + slot.astype(np.uint64)
        self.keys[slot] = keys[order[first[alone]]]

    def _slot(self, keys: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return (mixed(keys + seed * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.slots)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is none of the n."""
        seed = self.seeds[(keys % np.uint64(len(self.seeds))).astype(np.int64)]
        direct = seed >> np.uint64(32) > 0
        slot = np.where(direct, (seed & np.uint64(0xFFFFFFFF)).astype(np.int64), self._slot(keys, seed))
        return np.where(self.keys[slot] == keys, slot, -1)


def pretoken_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of pre-tokens, and the number of those before the end of each text."""
    at, code, kind = characters(data)
    if not len(at):
        return at, at, np.zeros(0, np.int64)
    group = np.where(kind == SPACE, OTHER_SPACE, kind)
    begins = np.ones(len(at), bool)
    begins[1:] = (group[1:] != group[:-1]) | (kind[1:] == END)
    run = np.flatnonzero(begins)
    stop = np.append(run[1:], len(at))
    # white space before another run: its last character stands alone, or joins the run if it is " "
    blank = (group[run] == OTHER_SPACE) & (stop < len(at))
    blank &= kind[np.minimum(stop, len(at) - 1)] != END
    last = stop[blank] - 1
    begins[last] = True
    begins[last[kind[last] == SPACE] + 1] = False
    # contractions: one lone apostrophe that begins a pre-token, then s t m d re ve ll
    mark = run[(code[run] == 39) & (stop - run == 1) & (kind[run] == SIGN) & begins[run]]
    a, b = (code[np.minimum(mark + k, len(at) - 1)] for k in (1, 2))
    one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    for marks, n in ((mark[one], 1), (mark[two], 2)):
        begins[marks + 1] = False
        rest = marks + 1 + n
        begins[rest[kind[np.minimum(rest, len(at) - 1)] == LETTER]] = True
    start = np.flatnonzero(begins)
    ends = np.append(at[start[1:]], len(data))
    final = kind[start] == END
    before = np.cumsum(~final)[final]
    return at[start][~final], ends[~final], before


class Codec:
    """The vocabulary with its perfect hash; shared with workers by broadcast."""

    def __init__(self, entries: list[bytes], remembered: int = CACHE):
        self.entries, self.remembered = entries, remembered
        data = np.frombuffer(b"".join(entries), np.uint8)
        ends = np.cumsum([len(e) for e in entries])
        keys = span_hash(prefix_hash(data), np.concatenate([[0], ends[:-1]]), ends)
        self.hash = PerfectHash(keys)
        self.ids = np.zeros(len(entries), np.int64)
        self.ids[self.hash.find(keys)] = np.arange(len(entries))
        self._set()

    def _set(self) -> None:
        self.ranks = {e: i for i, e in enumerate(self.entries)}
        self.single = [(i,) for i in range(len(self.entries))]
        self.pairs = [self.ranks.get(bytes((x, y)), -1) for x in range(256) for y in range(256)]
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.entries, self.remembered, self.hash, self.ids

    def __setstate__(self, state):
        self.entries, self.remembered, self.hash, self.ids = state
        self._set()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Tier two: always the lowest ranked pair, the leftmost of equals."""
        n, rank, push = len(piece), self.ranks.get, heapq.heappush
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        best = [self.pairs[x << 8 | y] for x, y in zip(piece, piece[1:])]  # rank of each symbol with the next one
        best.append(-1)
        heap = [r * n + i for i, r in enumerate(best) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if best[i] != r:
                continue
            m = end[i]
            e = end[i] = end[m]
            best[m] = -1
            best[i] = -1
            if e < n:
                left[e] = i
                r = rank(piece[i : end[e]])
                if r is not None:
                    best[i] = r
                    push(heap, r * n + i)
            p = left[i]
            if p >= 0:
                r = rank(piece[p:e])
                best[p] = -1 if r is None else r
                if r is not None:
                    push(heap, r * n + p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode_parts(self, texts: list[bytes]) -> Iterator[tuple[int, int, list[tuple[int, ...]], np.ndarray, np.ndarray]]:
        """By chunk: first and end text, ids of the distinct pre-tokens, all pre-tokens as numbers of those, and where each text's begin (n + 1 values)."""
        for i, j in chunks(texts):
            data = sealed(texts[i:j])
            s, e, before = pretoken_spans(data)
            if not len(s):
                yield i, j, [], np.zeros(0, np.int64), np.zeros(j - i + 1, np.int64)
                continue
            keys, first, inverse = np.unique(span_hash(prefix_hash(data), s, e), return_index=True, return_inverse=True)
            slot = self.hash.find(keys)
            ids = [self.single[k] if k >= 0 else None for k in np.where(slot >= 0, self.ids[slot], -1).tolist()]
            raw, cache = data.tobytes(), self.cache
            for k in np.flatnonzero(slot < 0).tolist():
                piece = raw[s[first[k]] : e[first[k]]]
                found = cache.get(piece)
                if found is None:
                    if len(cache) >= self.remembered:
                        self.older, self.cache = cache, {}
                        cache = self.cache
                    found = cache[piece] = self.older.get(piece) or self.merge(piece)
                ids[k] = found
            yield i, j, ids, inverse, np.append(0, before)

    def encode(self, texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """By chunk: first and end text, the ids of its texts in one array, and where each text's begin (n + 1 values)."""
        for i, j, ids, order, at in self.encode_parts(texts):
            size = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter((x for own in ids for x in own), np.int32, int(size.sum()))
            n, place = size[order], (np.cumsum(size) - size)[order]
            end = np.append(0, np.cumsum(n))
            yield i, j, flat[np.repeat(place - end[:-1], n) + np.arange(end[-1])], end[at]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.entries[i] for i in ids])

    def digests(self, texts: list[bytes]) -> Iterator[tuple[int, str, str]]:
        """n_tokens, hash of the ids as text, hash of the decoded ids; ids are written and decoded once per distinct pre-token."""
        sha = hashlib.sha256
        for i, j, ids, order, at in self.encode_parts(texts):
            size = list(map(len, ids))
            text = [b" ".join([b"%d" % x for x in own]) for own in ids]
            back = [self.decode(own) for own in ids]
            for k in range(j - i):
                doc = order[at[k] : at[k + 1]].tolist()
                yield sum([size[k] for k in doc]), sha(b" ".join([text[k] for k in doc])).hexdigest(), sha(b"".join([back[k] for k in doc])).hexdigest()


def load(path: str | None = None, remembered: int = CACHE) -> Codec:
    return Codec(read_ranks(path or public_tokenizers.path(VOCABULARY)), remembered)


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load(path, WIDE_CACHE))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            rows = list(codec.digests(as_bytes(batch.column(1))))
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None, name: str = "token_ids", count: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """``docs`` with its token ids and their number, which replace any columns of these names; without the text if it is not kept.

    Texts to drop never leave the workers, and ids leave them by the chunk, as one buffer of integers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load(path))
    docs = docs.drop(name, count)
    at = docs.columns.index("text")
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    schema = T.StructType([*fields, T.StructField(name, T.ArrayType(T.IntegerType(), False), False), T.StructField(count, T.LongType(), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        kind = pa.list_(pa.field("element", pa.int32(), False))
        for batch in batches:
            others = [c for k, c in enumerate(batch.columns) if keep_text or k != at]
            for i, j, flat, place in codec.encode(as_bytes(batch.column(at))):
                ids = pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(flat), type=kind)
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in others], ids, pa.array(np.diff(place))], names=schema.names)

    return docs.mapInArrow(work, schema)


def decoded(frame: DataFrame, path: str | None = None, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``frame`` with the bytes of its token ids; null ids give null."""
    spark = frame.sparkSession
    shared = spark.sparkContext.broadcast(load(path))
    at = frame.columns.index(ids)
    schema = T.StructType([*frame.schema.fields, T.StructField(name, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            back = pa.array([None if x is None else codec.decode(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, back], names=[*batch.schema.names, name])

    return frame.mapInArrow(work, schema)


def op5_two_tier_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
