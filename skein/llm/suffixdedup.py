"""Exact removal of repeated byte strings with suffix arrays in shards.

Every ``LENGTH``-byte string that also starts in a document with a smaller id is removed, wherever
it stands; strings never cross documents and are judged on the input.

Equal strings have the same least hash of their ``K``-byte parts, so strings are dealt to shards by
it: a text falls into segments, runs of strings that share this hash.  Hashes found in one document
only are dropped first.  Where all segments of a hash are equal bytes, their strings repeat as they are;
of all other segments each shard orders the suffixes by induced sorting and reads repeats off the
permuted common prefixes.  Strings below a hash that more than ``HOT`` batches hold
are not gathered in one shard but grouped as rows, with partial aggregation.

Null text is empty; a null id counts as larger than all others, and removes nothing from them.
Repeated rows of one id do not remove each other.  Texts shorter than ``LENGTH`` keep all bytes.
An empty table gives no rows; other columns are ignored by the digests and carried by ``without_repeats``.
The bytes that stay may break a character; ``without_repeats`` then drops its stray bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .inducedsort import common_prefixes, suffix_array
from .staging import small_batches, staged
from .textbytes import as_bytes, chunks, from_planes, from_rising, planes, prefix_hash, rising, span_hash

LENGTH, K = 50, 24
#: Entries of one hash in its bucket from which it is split by string; more for a larger input, so that
#: the broadcast hot hashes stay below about a million.
HOT = 1024
#: Text bytes for one group of documents, bucket of hashes or shard, and for those of one task.
GROUP_BYTES, TASK_BYTES = 8 << 20, 24 << 20
NO_ID = (1 << 63) - 1


class Segments:
    """Segments of a chunk of texts: hash, text number, byte place of the first string in the text, number of strings."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(size) - size
        n = len(self.data)
        empty = np.zeros(0, np.int64)
        self.value, self.doc, self.at, self.count = empty.astype(np.uint64), empty, empty, empty
        if n < LENGTH:
            return
        starts = np.arange(n - K + 1)
        low = span_hash(prefix_hash(self.data), starts, starts + K)
        width, have = LENGTH - K + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        owner = np.repeat(np.arange(len(texts)), size)[: n - LENGTH + 1]
        inside = np.arange(n - LENGTH + 1) + LENGTH <= (self.base + size)[owner]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(low)))
        keep = inside[first]
        first, self.count = first[keep], count[keep]
        self.value, self.doc = low[first], owner[first]
        self.at = first - self.base[self.doc]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _packed(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


def _by(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by part, and where each part begins (n + 1 values)."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


class Deal:
    """How many groups of documents, buckets and shards there are, and tasks for each."""

    def __init__(self, docs: DataFrame):
        self.bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.groups, self.tasks = max(12, self.bytes // GROUP_BYTES), max(12, self.bytes // TASK_BYTES)

    def group_of(self, key: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return (key ^ mark) % self.groups

    def keyed(self, docs: DataFrame) -> DataFrame:
        """All columns in one, and key: the id, nulls as the largest; mark: a hash that tells rows of one id apart; group."""
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
        return rows.withColumn("group", F.pmod(F.col("key").bitwiseXOR(F.col("mark")), F.lit(self.groups)).cast("int"))

    def by(self, df: DataFrame, column: str):
        return df.repartition(self.tasks, column).groupBy(column)


def _hash_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, key, mark, place, hash): for each batch and bucket, hashes with the place of their document in key and mark.

    A hash that several documents of a batch hold is known to be repeated: it goes to its bucket once,
    with minus the number of documents as its place, and to its documents in a row of a bucket below 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, key, mark = as_bytes(batch.column(2)), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j in chunks(texts):
                s = Segments(texts[i:j])
                order = np.lexsort((s.value, s.doc))
                v, d = s.value[order], s.doc[order]
                once = np.ones(len(v), bool)
                once[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
                values.append(v[once])
                owners.append(d[once] + i)
            v, d = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(v, kind="stable")
            v, d = v[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])[: len(v)])
            size = np.diff(np.append(first, len(v)))
            own = np.where(size == 1, d[first], -size)
            rows = []
            order, at = _by((v[first] % np.uint64(buckets)).astype(np.int64), buckets)
            for b in range(buckets):
                k = order[at[b] : at[b + 1]]
                if len(k):
                    seen = np.unique(own[k][own[k] >= 0])
                    local = np.where(own[k] >= 0, np.searchsorted(seen, own[k]), own[k]).astype(np.int32)
                    rows.append((b, key[seen].tobytes(), mark[seen].tobytes(), planes(local), rising(v[first[k]])))
            many = np.repeat(size > 1, size)
            if many.any():
                seen, local = np.unique(d[many], return_inverse=True)
                rows.append((-1 - int(mark[seen[0]]) % buckets, key[seen].tobytes(), mark[seen].tobytes(), planes(local.astype(np.int32)), rising(v[many])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *map(_packed, cols[1:])], names=["bucket", "key", "mark", "place", "hash"])

    return docs.select("key", "mark", "text").mapInArrow(work, "bucket int, key binary, mark binary, place binary, hash binary")


_TOLD = "group int, key binary, mark binary, place binary, hash binary"


def _to_groups(group: np.ndarray, key: np.ndarray, mark: np.ndarray, place: np.ndarray, value: np.ndarray) -> list[tuple]:
    """Packed rows, one a group: its documents, and for each value the place of its document among them."""
    order, at = _by(group[place], int(group.max(initial=-1)) + 1)
    rows = []
    for g in np.flatnonzero(np.diff(at)).tolist():
        own = order[at[g] : at[g + 1]]
        seen, local = np.unique(place[own], return_inverse=True)
        rows.append((g, key[seen].tobytes(), mark[seen].tobytes(), planes(local.astype(np.int32)), value[own].tobytes()))
    return rows


def _packed_rows(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(cols[0], pa.int32()), *map(_packed, cols[1:])], names=names)


def _by_document(table: pa.Table, column: str, kind: type, width: int = 1) -> dict[tuple[int, int], np.ndarray]:
    """The values of packed rows by key and mark."""
    parts = []
    for r in table.select(["key", "mark", "place", column]).to_pylist():
        at = from_planes(r["place"], np.int32)
        parts.append((np.frombuffer(r["key"], np.int64)[at], np.frombuffer(r["mark"], np.int64)[at], np.frombuffer(r[column], kind).reshape(-1, width)))
    if not parts:
        return {}
    k, m, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((m, k))
    k, m, value = k[order], m[order], value[order]
    heads = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])))
    return {(int(k[a]), int(m[a])): value[a:b] for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(k)], strict=True)}


def _repeated(rows: DataFrame, hot: int, deal: Deal) -> DataFrame:
    """Packed rows of each document's hashes that other documents hold too, by group; group null: hot hashes."""
    names = [f.split()[0] for f in _TOLD.split(", ")]

    def bucket(table: pa.Table) -> pa.Table:
        held = table.to_pylist()
        key, mark = (np.concatenate([np.frombuffer(r[c], np.int64) for r in held]) for c in ("key", "mark"))
        first = np.cumsum([0, *[len(r["key"]) // 8 for r in held]])
        place = [from_planes(r["place"], np.int32).astype(np.int64) for r in held]
        where = np.concatenate([np.where(p >= 0, p + f, p) for p, f in zip(place, first, strict=False)])
        value = np.concatenate([from_rising(r["hash"]) for r in held])
        repeated, out = np.ones(len(value), bool), []
        if held[0]["bucket"] >= 0:
            keys, inv = np.unique(value, return_inverse=True)
            repeated = (np.bincount(inv, np.where(where < 0, -where, 1)) > 1)[inv] & (where >= 0)
            warm = keys[np.bincount(inv) > hot]
            out.append((None, b"", b"", b"", warm.tobytes()))
        out += _to_groups(deal.group_of(key, mark), key, mark, where[repeated], value[repeated])
        return _packed_rows(out, names)

    return deal.by(rows, "bucket").applyInArrow(bucket, _TOLD)


def _sharded(dealt: DataFrame, told: DataFrame, warm: np.ndarray, deal: Deal) -> DataFrame:
    """Groups of documents and their repeated hashes to rows of segments by shard.

    Hot hashes give their strings one by one, dealt by the string.  Of equal segments in a group only
    that of the smallest id goes on; the others are repeats of it (rows of a shard below 0).
    """
    names = ["shard", "key", "mark", "place", "at", "count", "hash", "bytes"]
    shards = deal.groups
    shared = dealt.sparkSession.sparkContext.broadcast(np.sort(warm))

    def work(table: pa.Table, told: pa.Table) -> pa.Table:
        warm, hashes, none = shared.value, _by_document(told, "hash", np.uint64), np.zeros((0, 1), np.uint64)
        keys, marks = table.column("key").to_numpy(), table.column("mark").to_numpy()
        own = [hashes.get(x, none)[:, 0] for x in zip(keys.tolist(), marks.tolist(), strict=True)]
        some = np.flatnonzero([len(x) for x in own])
        keys, marks, own = keys[some], marks[some], [own[x] for x in some.tolist()]
        texts = as_bytes(table.column("row").combine_chunks().field("text").take(pa.array(some)))
        parts, rows, out = [], [], []
        for i, j in chunks(texts):
            s = Segments(texts[i:j])
            pairs = np.concatenate([h + np.array(k, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k, h in enumerate(own[i:j])])
            keep = np.flatnonzero(np.isin(s.value + s.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), pairs))
            value, doc, at, count = s.value[keep], s.doc[keep], s.at[keep], s.count[keep]
            h = prefix_hash(s.data)
            hot = np.isin(value, warm)
            if hot.any():
                n = np.where(hot, count, 1)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hot, doc, value = (np.repeat(x, n) for x in (hot, doc, value))
                at, count = np.repeat(at, n) + step, np.where(hot, 1, np.repeat(count, n))
                begin = s.base[doc] + at
                value = np.where(hot, span_hash(h, begin, begin + LENGTH), value)
            begin = s.base[doc] + at
            end = begin + count + LENGTH - 1
            raw = s.data.tobytes()
            parts.append((value, doc + i, at, count, span_hash(h, begin, end)))
            rows += [raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
        if rows:
            value, doc, at, count, seg = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, keys[doc], seg))
            head = np.ones(len(order), bool)
            head[1:] = seg[order][1:] != seg[order][:-1]
            leader = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
            later = keys[doc[order]] > keys[doc[order[leader]]]
            for x in np.flatnonzero(later).tolist():  # equal hashes are only a hint
                later[x] = rows[order[x]] == rows[order[leader[x]]]
            done, sent = np.sort(order[later]), np.sort(order[head])
            # equal segments of one id: none repeats the other, all go on
            sent = np.sort(np.concatenate([sent, order[~head & ~later]]))
            shard = np.empty(len(sent) + len(done), np.int64)
            shard[: len(sent)] = (value[sent] >> np.uint64(20)).astype(np.int64) % shards
            shard[len(sent) :] = shards
            pick = np.concatenate([sent, done])
            group, place = _by(shard, shards + 1)
            for b in range(shards + 1):
                k = pick[group[place[b] : place[b + 1]]]
                if not len(k):
                    continue
                number, hashed, data = -1 - int(marks[doc[k[0]]]) % shards, b"", b""
                if b < shards:
                    k = k[np.argsort(value[k], kind="stable")]
                    number, hashed, data = b, rising(value[k]), b"".join([rows[x] for x in k.tolist()])
                seen, local = np.unique(doc[k], return_inverse=True)
                numbers = [planes(x.astype(np.int32)) for x in (local, at[k], count[k])]
                out.append((number, keys[seen].tobytes(), marks[seen].tobytes(), *numbers, hashed, data))
        return _packed_rows(out, names)

    pairs = deal.by(dealt, "group").cogroup(deal.by(told, "group"))
    return pairs.applyInArrow(work, "shard int, key binary, mark binary, place binary, at binary, count binary, hash binary, bytes binary")


def _owners(segments: list[bytes], first: np.ndarray) -> list[np.ndarray]:
    """For each distinct segment, the smallest first id of any segment that holds each of its strings."""
    size = np.array([len(x) for x in segments], np.int64)
    base = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(b"\0".join([*segments, b""]), np.uint8)
    t = data.astype(np.int64) + 2
    t[base + size] = 1
    sa = suffix_array(np.append(t, 0), 258)[1:]
    owner = np.repeat(np.arange(len(segments)), size + 1)
    whole = np.arange(len(data)) + LENGTH <= (base + size)[owner]
    same = common_prefixes(data, sa, LENGTH)[sa] >= LENGTH
    keep = whole[sa]
    group = np.cumsum(~same)[keep]
    sa = sa[keep]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(first[owner[sa]], heads)
    out = np.full(len(data), NO_ID, np.int64)
    out[sa] = np.repeat(least, np.diff(np.append(heads, len(sa))))
    return [out[b : b + n - LENGTH + 1] for b, n in zip(base.tolist(), size.tolist(), strict=True)]


#: Bytes of distinct segments whose suffixes are ordered together, and segments whose strings are listed together.
SORTED, ROWS = 1 << 20, 1 << 16


def _first_owners(segments: list[bytes], value: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each distinct segment, the smallest first id for each of its strings; equal values stand together."""
    size = np.array([len(x) for x in segments], np.int64) - LENGTH + 1
    out: list[np.ndarray] = [np.full(n, x) for n, x in zip(size.tolist(), first.tolist(), strict=True)]
    new = np.append(True, value[1:] != value[:-1])
    several = np.flatnonzero(~(new & np.append(new[1:], True)))
    if len(several):
        turn = np.cumsum(size[several] + LENGTH) // SORTED
        heads = new[several]
        turn = turn[np.maximum.accumulate(np.where(heads, np.arange(len(several)), 0))]  # segments of one value stay together
        for part in np.split(several, np.flatnonzero(np.diff(turn)) + 1):
            for k, owners in zip(part.tolist(), _owners([segments[x] for x in part.tolist()], first[part]), strict=True):
                out[k] = owners
    return out


def _spans(shards: DataFrame, deal: Deal) -> DataFrame:
    """Packed rows of the (start, end) bytes to remove that each shard has found, by group of documents."""

    def shard(table: pa.Table) -> pa.Table:
        held = table.to_pylist()
        places = [from_planes(r["place"], np.int32) for r in held]
        key, mark = (np.concatenate([np.frombuffer(r[c], np.int64)[at] for r, at in zip(held, places, strict=True)]) for c in ("key", "mark"))
        at, count = (np.concatenate([from_planes(r[c], np.int32) for r in held]).astype(np.int64) for c in ("at", "count"))
        if held[0]["shard"] < 0:
            row, start, end = np.arange(len(key)), at, at + count + LENGTH - 1
        else:
            value, ends = np.concatenate([from_rising(r["hash"]) for r in held]), np.cumsum(count + LENGTH - 1)
            data, starts = b"".join([r["bytes"] for r in held]), np.append(0, ends[:-1])
            rows, lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            order = np.argsort(value, kind="stable")
            number: dict[tuple[int, bytes], int] = {}
            which = np.array([number.setdefault((v, data[starts[x] : ends[x]]), len(number)) for x, v in zip(order.tolist(), value[order].tolist(), strict=True)], np.int64)
            first = np.full(len(number), NO_ID, np.int64)
            np.minimum.at(first, which, key[order])
            owners = _first_owners([x for _, x in number], np.array([v for v, _ in number], np.uint64), first)
            for a in range(0, len(order), ROWS):
                own, numbers = order[a : a + ROWS], which[a : a + ROWS]
                n = count[own]
                from_first = np.concatenate([owners[w] for w in numbers.tolist()])
                row = np.repeat(own, n)
                place = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                hit = from_first < key[row]
                row, place = row[hit], place[hit]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
                head = np.flatnonzero(new)
                rows.append(row[head])
                lows.append(place[head])
                highs.append(place[np.append(head[1:], len(row)) - 1] + LENGTH if len(row) else place)
            row, start, end = (np.concatenate(x) for x in (rows, lows, highs))
        pair = np.stack([start, end], 1).astype(np.int32)
        return _packed_rows(_to_groups(deal.group_of(key, mark), key, mark, row, pair), ["group", "key", "mark", "place", "spans"])

    return deal.by(shards, "shard").applyInArrow(shard, "group int, key binary, mark binary, place binary, spans binary")


def with_spans(docs: DataFrame, work: Callable[[pa.Table, list[list[tuple[int, int]]]], pa.Table], schema: str | T.StructType) -> DataFrame:
    """``work`` on groups of documents (their columns in ``row``) and the maximal runs of bytes to remove from each."""
    small_batches(docs.sparkSession)
    deal = Deal(docs)
    dealt = deal.keyed(docs)
    rows = _hash_rows(dealt.select("key", "mark", F.col("row.text").alias("text")), deal.groups)
    told = staged(_repeated(rows, max(HOT, deal.bytes // (LENGTH << 20)), deal), "repeated")
    warm = [np.frombuffer(r.hash, np.uint64) for r in told.filter("group IS NULL").select("hash").collect()]
    shards = _sharded(dealt, told.filter("group IS NOT NULL"), np.concatenate([*warm, np.zeros(0, np.uint64)]), deal)

    def final(table: pa.Table, found: pa.Table) -> pa.Table:
        spans = _by_document(found, "spans", np.int32, 2)
        keys = zip(table.column("key").to_pylist(), table.column("mark").to_pylist(), strict=True)
        return work(table, [merged_spans(spans.get(x)) for x in keys])

    return deal.by(dealt, "group").cogroup(deal.by(_spans(shards, deal), "group")).applyInArrow(final, schema)


def merged_spans(pair: np.ndarray | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes to remove."""
    if pair is None or not len(pair):
        return []
    pair = pair[np.argsort(pair[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pair[:, 1])
    heads = np.flatnonzero(np.concatenate([[True], pair[1:, 0] > reach[:-1]]))
    return list(zip(pair[heads, 0].tolist(), reach[np.append(heads[1:], len(pair)) - 1].tolist(), strict=True))


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def work(table: pa.Table, spans: list[list[tuple[int, int]]]) -> pa.Table:
        row, out = table.column("row").combine_chunks(), []
        for text, own in zip(as_bytes(row.field("text")), spans, strict=True):
            kept = kept_bytes(text, own)
            out.append((len(text), len(text) - len(kept), len(own), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([row.field("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=names)

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_spans(thin, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut from the texts; a broken character at a cut goes too.  Null texts stay null."""
    at, schema = docs.columns.index("text"), T.StructType(docs.schema.fields)

    def work(table: pa.Table, spans: list[list[tuple[int, int]]]) -> pa.Table:
        columns = table.column("row").combine_chunks().flatten()
        texts = [t if t is None or not own else kept_bytes(t.encode(), own).decode("utf-8", "ignore") for t, own in zip(columns[at].to_pylist(), spans, strict=True)]
        columns[at] = pa.array(texts, pa.string())
        return pa.table(columns, names=schema.names)

    return with_spans(docs, work, schema)


def op9_induced_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM (SELECT *, unnest(range(0, len(h) // 2 - 49)) AS i FROM t WHERE len(h) >= 100)),
f AS (SELECT r, i, min(doc_id) OVER (PARTITION BY x) AS first, doc_id FROM p),
g AS (SELECT r, i FROM f WHERE first < doc_id),
o AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g),
k AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM o),
sp AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY 1, 2),
q AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before, row_number() OVER (PARTITION BY r ORDER BY a DESC) AS last FROM sp),
kept AS (SELECT q.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || max(CASE WHEN last = 1 THEN substr(h, 2 * b + 1) ELSE '' END) AS h,
    sum(b - a) AS n_removed, count(*) AS n_spans FROM q JOIN t ON t.r = q.r GROUP BY q.r)
SELECT doc_id, len(t.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256 FROM t LEFT JOIN kept ON kept.r = t.r
"""
