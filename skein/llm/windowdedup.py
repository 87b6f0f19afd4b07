"""Removal of repeated word windows by Rabin-Karp hashes.

A window is ``WIDTH`` consecutive words of one text.  Each word covered by a window whose words also
start earlier (in a document of a smaller id, or further up in the same text) is removed; windows are
judged on the input.

Texts are dealt to groups, which are ranges of ids.  Each group hashes all its windows with two rolling
polynomials over the hashes of words: one chooses the bucket, the other (64 bits) is what the bucket counts.
A bucket gets each hash once from every group that holds it and answers all groups but that of the smallest
ids, so that one row a group and bucket is all that moves, whatever the number of copies.  What a group
repeats within itself it finds alone.  Windows are equal when both hashes are.

Null text has no words; texts shorter than ``WIDTH`` words keep them all.  A null id counts as larger than
all others.  Rows of one id, also equal ones, are texts of their own that do not remove each other's windows.
An empty table gives no rows.  Other columns are carried in ``row``, whatever their names.  Memory follows
``GROUP_BYTES`` or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import small_batches
from .textbytes import CHUNK, as_bytes, from_rising, joined, mixed, prefix_hash, rising, rolled, span_hash, word_spans

WIDTH = 20
#: Bytes of text for a group of documents and for a bucket of hashes.
GROUP_BYTES = 10 << 20
#: What a row counts besides its text.
ROW_BYTES = 64
NO_ID = (1 << 63) - 1
SECOND = np.uint64(0xA0761D6478BD642F)


class Words:
    """The words of some texts and the hash of each."""

    def __init__(self, texts: list[bytes]):
        self.data, at = joined(texts)
        self.start, self.end, self.count = word_spans(self.data, at)
        self.first = np.cumsum(self.count) - self.count
        self.value = np.zeros(len(self.start), np.uint64)
        for i, j in self._slices():
            low = self.start[i]
            own = prefix_hash(self.data[low : self.end[j - 1]])
            self.value[i:j] = span_hash(own, self.start[i:j] - low, self.end[i:j] - low)

    def _slices(self) -> Iterator[tuple[int, int]]:
        """Ranges of words that span about ``CHUNK`` bytes, one word at least."""
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + CHUNK, "right")))
            yield i, j
            i = j

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place (word number), text number, and the two hashes of every window."""
        place = np.arange(max(0, len(self.value) - width + 1))
        text = np.repeat(np.arange(len(self.count)), self.count)[: len(place)]
        inside = place + width <= (self.first + self.count)[text]
        one, two = rolled(self.value, width), rolled(mixed(self.value ^ SECOND), width)
        return place[inside], text[inside], one[inside], two[inside]


class Deal:
    """Groups of documents: ranges of ids, with those of one crowded id split by their texts and row numbers.

    The row numbers are those of the input's partitions, so the input should be a table, or its result staged.
    """

    def __init__(self, docs: DataFrame):
        key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
        size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)
        self.bytes = docs.agg(size).first()[0] or 0
        self.parts = max(12, self.bytes // GROUP_BYTES)
        cuts = docs.agg(F.percentile_approx(key, [k / self.parts for k in range(1, self.parts)], 20 * self.parts)).first()[0] or []
        crowded = {a for a, b in zip(cuts, cuts[1:], strict=False) if a == b}
        bounds = sorted({*cuts, *(x - 1 for x in crowded)})
        rank = self._rank(key, bounds)
        alone = [k for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False), 1) if b == a + 1] + ([len(bounds)] if bounds and bounds[-1] == NO_ID - 1 else [])
        sizes = {r.rank: r.bytes for r in docs.groupBy(rank.alias("rank")).agg(size.alias("bytes")).collect()} if alone else {}
        salts = {k: -(-sizes[k] // GROUP_BYTES) for k in alone if sizes.get(k, 0) > GROUP_BYTES}
        salt = F.lit(0)
        if salts:
            of = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])
            salt = F.coalesce(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.try_element_at(of, rank)), F.lit(0)).cast("int")
        self.docs = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), rank.alias("rank"), salt.alias("salt"))

    @staticmethod
    def _rank(key, bounds: list[int]):
        """How many bounds are below the key, by bisection."""
        if not bounds:
            return F.lit(0)
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
        held = F.lit(bounds).cast("array<bigint>")
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(held, at + step) < key, at + step).otherwise(at))

    def by(self, df: DataFrame, *columns: str):
        return df.repartition(self.parts, *columns).groupBy(*columns)


def _texts(table: pa.Table) -> list[bytes]:
    return as_bytes(table.column("row").combine_chunks().field("text"))


def _cells(deal: Deal, width: int) -> DataFrame:
    """For each group and bucket, the hashes of its windows, each once, in rising order."""
    buckets = deal.parts

    def work(table: pa.Table) -> pa.Table:
        _, _, value, other = Words(_texts(table)).windows(width)
        bucket = (other % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((value, bucket))
        value, bucket = value[order], bucket[order]
        once = np.ones(len(value), bool)
        once[1:] = (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])
        value, bucket = value[once], bucket[once]
        head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        parts = [rising(x) for x in np.split(value, head[1:])] if len(head) else []
        rank, salt = table.column("rank")[0], table.column("salt")[0]
        return pa.table({"bucket": bucket[head], "rank": pa.array([rank] * len(head), pa.int32()), "salt": pa.array([salt] * len(head), pa.int32()), "hashes": pa.array(parts, pa.binary())})

    return deal.by(deal.docs, "rank", "salt").applyInArrow(work, "bucket int, rank int, salt int, hashes binary")


def _held_before(cells: DataFrame, deal: Deal) -> DataFrame:
    """For each group, the hashes that a group of smaller ids holds too."""

    def work(table: pa.Table) -> pa.Table:
        parts = [from_rising(x) for x in table.column("hashes").to_pylist()]
        size = np.array([len(x) for x in parts])
        rank = np.repeat(table.column("rank").to_numpy(), size)
        value = np.concatenate(parts)
        order = np.lexsort((rank, value))
        head = np.append(True, value[order][1:] != value[order][:-1])
        least = rank[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        later = np.zeros(len(value), bool)
        later[order] = rank[order] > least
        found = [x[own] for x, own in zip(parts, np.split(later, np.cumsum(size)[:-1]), strict=True)]
        some = [k for k, x in enumerate(found) if len(x)]
        return table.select(["rank", "salt"]).take(pa.array(some, pa.int64())).append_column("hashes", pa.array([rising(found[k]) for k in some], pa.binary()))

    return deal.by(cells, "bucket").applyInArrow(work, "rank int, salt int, hashes binary")


def _repeats(text: np.ndarray, key: np.ndarray, value: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which windows of a group start earlier in it: under a smaller id, or in the same text.  Windows come in the order of their place."""
    order = np.lexsort((text, key[text], other, value))
    v, o, t = value[order], other[order], text[order]
    head = np.ones(len(order), bool)
    head[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    first = t[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    again = np.zeros(len(order), bool)
    again[1:] = ~head[1:] & (t[1:] == t[:-1])
    out = np.zeros(len(order), bool)
    out[order] = again | (key[t] > key[first])
    return out


def _kept(words: Words, gone: np.ndarray) -> list[str]:
    """The words that stay of each text, joined by one space."""
    start, end = words.start[~gone], words.end[~gone]
    data, edge = words.data.copy(), np.zeros(len(words.data) + 1, np.int8)
    data[end] = 32
    edge[start] += 1
    edge[end + 1] -= 1
    flat = data[np.cumsum(edge, dtype=np.int8)[:-1] > 0].tobytes()
    size = np.append(0, np.cumsum(end - start + 1))
    at = size[np.append(0, np.cumsum(~gone))[np.append(words.first, len(gone))]]
    return [flat[a : max(a, b - 1)].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row a document: its columns in ``row``, its number of words, the maximal intervals of words to remove
    (first, and one past the last, from 0), and the words that stay, joined by one space."""
    small_batches(docs.sparkSession)
    deal = Deal(docs)
    interval = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema = T.StructType([deal.docs.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("removed", interval), T.StructField("kept", T.StringType())])

    def work(table: pa.Table, told: pa.Table) -> pa.Table:
        words, key = Words(_texts(table)), table.column("key").to_numpy()
        place, text, value, other = words.windows(width)
        known = np.concatenate([*map(from_rising, told.column("hashes").to_pylist()), np.zeros(0, np.uint64)])
        hit = np.isin(value, known) | _repeats(text, key, value, other)
        edge = np.zeros(len(words.value) + 1, np.int32)
        edge[place[hit]] += 1
        edge[place[hit] + width] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        owner = np.repeat(np.arange(len(key)), words.count)
        begin, stop = gone.copy(), gone.copy()
        begin[1:] &= ~gone[:-1] | (owner[1:] != owner[:-1])
        stop[:-1] &= ~gone[1:] | (owner[1:] != owner[:-1])
        a, b = np.flatnonzero(begin), np.flatnonzero(stop)
        lists = np.searchsorted(owner[a], np.arange(len(key) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array((x - words.first[owner[a]]).astype(np.int32)) for x in (a, b + 1)], ["start", "stop"])
        return pa.table([table.column("row"), pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(lists), pairs), pa.array(_kept(words, gone), pa.string())], names=schema.names)

    told = _held_before(_cells(deal, width), deal)
    return deal.by(deal.docs, "rank", "salt").cogroup(deal.by(told, "rank", "salt")).applyInArrow(work, schema)


def without_repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the words that stay as their texts; texts that lose nothing, and null, stay as they are."""
    found = repeated_windows(docs, width)
    kept = F.when(F.size("removed") == 0, F.col("row.text")).otherwise(F.col("kept"))
    return found.select(*[(kept if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def op12_rabin_karp_windows(spark, sf_dir: str) -> DataFrame:
    found = repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x.stop - x.start)
    return found.select("row.doc_id", "n_words", gone.alias("n_removed"), F.size("removed").alias("n_intervals"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
j AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
p AS (SELECT r, doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i : i + 19], ' ') END AS x FROM j),
f AS (SELECT *, x IS NOT NULL AND (min(doc_id) OVER (PARTITION BY x) < doc_id OR min(i) OVER (PARTITION BY x, r) < i) AS hit FROM p),
g AS (SELECT *, max(hit::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS opens FROM g),
k AS (SELECT r, count(*) AS n, sum(gone) AS gone, sum(opens) AS spans, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::INT AS n_intervals, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.r = t.r
"""
