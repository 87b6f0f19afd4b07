"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles.  Shingles are ordered by estimated frequency, then hash.
Two sets of n and m that reach the threshold share ``o = ceil(t / (1 + t) (n + m))`` shingles, and so
at least L of the first ``n - o + L`` and ``m - o + L`` of each, for every L.  Each document takes the L
of least estimated cost: the meetings of its prefix, plus those candidates that L shared shingles may
still leave.  A pair uses the smaller L of its two documents.

Documents with one set are one class from the start.  Classes that meet on a shingle are first
compared with a pivot of that shingle and size band, in turns that go on while they pay; only classes
that are then still in different components are paired, each outside the shingle's largest component
with all others, so that a large group of near copies gives one comparison per member instead of all
pairs.  A candidate's sketch, counts of its set by cell, bounds the intersection from above; pairs that
may still reach the threshold are compared on the whole sets.  The result is exact.

Words are separated by ASCII white space and A-Z is lower-cased.  A text with fewer words than a
shingle is one shingle; null, empty and blank texts have an empty set and link with nothing.
Repeated rows are members of one class, rows of one id with different texts each of their own.  A null
id counts as larger than all others.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import drop_staged, small_batches, staged
from .textbytes import as_bytes, chunks, joined, mixed, prefix_hash, span_hash, word_spans

#: The longest L.
LEVELS = 12
#: Estimated costs in meetings: of a candidate, and of a row of a prefix; and the meetings of a shingle not known to repeat.
CANDIDATE, ROW, UNKNOWN = 16.0, 0.05, 0.05
#: Shingles of one task that are counted together, and counts that are passed on.
COUNTED, PASSED_ON = 1 << 21, 2
#: The broadcast estimate: counts of the most frequent shingles, and one bit for all that were seen
#: to repeat, by the first bits of the hash.  Both are of fixed size; a full table only costs time.
FREQUENT, MOST_FREQUENT, BITS, SLICES = 24, 1 << 18, 26, 64
#: Pivot turns go on while the last turn would make more rows than so many a shared shingle, and each turn takes a fifth off.
ROWS_EACH = 2
#: Salt of shingles known to be frequent, whose rows need not come together.
SALT = 64
#: Nodes that a worker remembers to send the prefix of copies once.
REMEMBERED = 1 << 17
NO_ID = (1 << 63) - 1


def shingle_sets(texts: list[bytes], width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By chunk: (first text, end text, distinct shingle hashes text by text, number of each text)."""
    for i, j in chunks(texts):
        data, at = joined(texts[i:j])
        s, e, n = word_spans(data, at)
        h = span_hash(prefix_hash(data, lower=True), s, e)
        doc = np.repeat(np.arange(j - i), n)
        first = np.cumsum(n) - n
        room = (np.repeat(first + n, n) - np.arange(len(h))).astype(np.int64)  # words from here to the end of the text
        starts = np.flatnonzero((room >= width) | ((np.arange(len(h)) == first[doc]) & (n[doc] < width)))
        shingle = np.zeros(len(starts), np.uint64)
        for k in range(width):
            inside = room[starts] > k
            shingle[inside] = mixed(shingle[inside] * np.uint64(0x9E3779B97F4A7C15) + h[starts[inside] + k] + np.uint64(k + 1))
        doc = doc[starts]
        order = np.lexsort((shingle, doc))
        shingle, doc = shingle[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
        yield i, j, shingle[new], doc[new]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def bands(n: np.ndarray, percent: int) -> np.ndarray:
    """Size band of each set: sets that reach the threshold are in one band or in neighbouring ones."""
    edge, edges = 1, []
    while edge < 1 << 32:
        edges.append(edge)
        edge = edge * 100 // percent + 1
    return np.searchsorted(np.array(edges), n, "right")


def sketches(shingle: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Per set, how many shingles fall into each of 2^k cells, k by the size: 2 to 4 a cell; 255 stands for more."""
    cells = np.left_shift(1, np.maximum(np.frexp(np.maximum(n, 1) / 2.0)[1] - 1, 0).astype(np.int64))
    first = np.cumsum(cells) - cells
    count = np.bincount(first[doc] + (shingle & (cells[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=int(cells.sum()))
    packed = np.minimum(count, 255).astype(np.uint8).tobytes()
    return [packed[x : x + k] for x, k in zip(first.tolist(), cells.tolist(), strict=True)]


def most_shared(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """An upper bound of the intersection of two sets of each pair, from their sketches."""
    out = np.zeros(len(a), np.int64)
    size = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for x, y in np.unique(size, axis=0).tolist():
        own = np.flatnonzero((size == (x, y)).all(1))
        z = min(x, y)
        u, v = (np.frombuffer(b"".join([side[k] for k in own.tolist()]), np.uint8).reshape(len(own), -1, z) for side in (a, b))
        full = (u == 255).any((1, 2)) | (v == 255).any((1, 2))
        out[own] = np.where(full, 1 << 40, np.minimum(u.sum(1, dtype=np.int64), v.sum(1, dtype=np.int64)).sum(1))
    return out


def nodes_of(shingle: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Hash of each set."""
    value = np.zeros(texts, np.uint64)
    np.add.at(value, doc, mixed(shingle))
    return mixed(value)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, mark, n, value, sketch, kind): size, hash and sketch of each document's set (kind 0), or a local count of a shingle (kind 1).

    ``mark`` is a hash of the text, which tells rows of one id apart.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "mark", "n", "value", "sketch", "kind"]

    def repeated(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        keys, n = keys[n >= PASSED_ON], n[n >= PASSED_ON]
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(n), _signed(keys), pa.nulls(len(keys), pa.binary()), pa.array(np.ones(len(keys), np.int32))], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for i, j, shingle, doc in shingle_sets(as_bytes(batch.column(2)), width):
                n = np.bincount(doc, minlength=j - i)
                own = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), _signed(nodes_of(shingle, doc, j - i))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sketches(shingle, doc, n), pa.binary()), pa.array(np.zeros(j - i, np.int32))], names=names)
                held.append(shingle)
                if sum(map(len, held)) > COUNTED:
                    yield repeated(held)
                    held = []
        if held:
            yield repeated(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), "text")
    return rows.mapInArrow(work, "doc_id long, mark long, n long, value long, sketch binary, kind int")


def text_mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _cells(value: np.ndarray) -> np.ndarray:
    return (value.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


def _marked(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    cell = _cells(value)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0


def bit_table(values: DataFrame) -> np.ndarray:
    """One bit for each cell of the first ``BITS`` bits of a hash: whether any ``value`` falls into it."""
    cells = (1 << BITS) // SLICES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = _cells(batch.column(0).to_numpy())
            for k in np.unique(cell // cells).tolist():
                own = marks.setdefault(k, np.zeros(cells, bool))
                own[cell[cell // cells == k] % cells] = True
        packed = [np.packbits(m).tobytes() for m in marks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(marks), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "bits"])

    slices = F.shiftrightunsigned("value", 64 - SLICES.bit_length() + 1)
    rows = values.select("value").repartition(SLICES, slices).mapInArrow(work, "slice int, bits binary").toArrow()
    out = np.zeros((SLICES, cells // 8), np.uint8)
    for k, bits in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        out[k] |= np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


_PREFIX = "token long, node long, n int, place int, need int, band int, sure boolean"


def cheapest_level(cost: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """L of each document by estimated cost; ``cost`` holds the meetings of all shingles, document by document, in their order.

    The estimate is made for partners of the same size, whose prefixes have ``n - o + L`` shingles.
    """
    total = np.append(0.0, np.cumsum(cost))
    first = np.cumsum(n) - n
    spare = n - -(-2 * n * percent // (100 + percent))
    best, need = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for level in range(1, LEVELS + 1):
        rows = np.minimum(spare + level, n)
        meetings = total[first + rows] - total[first]
        price = meetings * (1 + CANDIDATE / level) + ROW * rows
        better = (price < best) & ((level == 1) | (spare + level <= n))
        best[better], need[better] = price[better], level
    return need


def prefix_table(docs: DataFrame, width: int, percent: int, frequent: pa.Table, bits: np.ndarray) -> DataFrame:
    """The shingles of each set's longest prefix with their places in its order, its L and size band, and whether the shingle is known to be frequent."""
    spark = docs.sparkSession
    small_batches(spark)
    keys = frequent.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], frequent.column(1).to_numpy()[order], bits))
    names = [f.split()[0] for f in _PREFIX.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, bits = shared.value
        sent: set[int] = set()
        for batch in batches:
            for i, j, shingle, doc in shingle_sets(as_bytes(batch.column(0)), width):
                n, node = np.bincount(doc, minlength=j - i), nodes_of(shingle, doc, j - i)
                fresh = np.zeros(j - i, bool)
                for k, x in enumerate(node.tolist()):
                    fresh[k] = x not in sent
                    sent.add(x)
                if len(sent) > REMEMBERED:
                    sent = set()
                shingle, doc = shingle[fresh[doc]], (np.cumsum(fresh) - 1)[doc[fresh[doc]]]
                n, node = n[fresh], node[fresh]
                often = np.where(_marked(bits, shingle), 2, 0)
                seen = np.flatnonzero(often)
                sure = np.zeros(len(shingle), bool)
                if len(keys) and len(seen):
                    k = np.minimum(np.searchsorted(keys, shingle[seen]), len(keys) - 1)
                    sure[seen] = keys[k] == shingle[seen]
                    often[seen] = np.where(sure[seen], counts[k], 2)
                order = np.lexsort((shingle, often, doc))
                shingle, often, sure = shingle[order], often[order], sure[order]
                place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                need = cheapest_level(np.maximum(often, UNKNOWN), n, percent)
                least = -(-n * percent // 100)  # no partner is smaller
                own = place < np.minimum(n - least + need, n)[doc]
                doc = doc[own]
                columns = [n[doc], place[own], need[doc], bands(n, percent)[doc]]
                yield pa.RecordBatch.from_arrays(
                    [_signed(shingle[own]), _signed(node[doc]), *(pa.array(c.astype(np.int32)) for c in columns), pa.array(sure[own])], names=names
                )

    return docs.select("text").mapInArrow(work, _PREFIX)


def shared_only(prefixes: DataFrame) -> DataFrame:
    """The rows of shingles that several sets hold in their prefixes, one row a set; rows of frequent shingles always.

    Rows come sorted by shingle and set; a row stays if a neighbour has the same shingle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = None, False  # the row that waits for its next one, and whether it has met its previous one
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            token, node, sure = (table.column(c).to_numpy() for c in ("token", "node", "sure"))
            new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
            table, token, sure = table.filter(pa.array(new)), token[new], sure[new]
            same = token[1:] == token[:-1]
            before, after = np.append(met, same), np.append(same, False)
            keep = before | after | sure
            keep[-1] = False
            last, met, held = table.slice(len(token) - 1).to_batches()[0], bool(before[-1]), bool(sure[-1])
            yield from table.filter(pa.array(keep)).to_batches()
        if last is not None and (met or held):
            yield last

    salt = F.when(F.col("sure"), F.pmod(F.col("node"), F.lit(SALT))).otherwise(F.lit(0))
    return prefixes.repartition("token", salt).sortWithinPartitions("token", "node").mapInArrow(work, _PREFIX).drop("sure")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) pairs of set hashes whose whole sets reach the threshold; ``classes``: (node, rep, n_shingles, sketch)."""
    spark = docs.sparkSession
    side = lambda x: classes.select(F.col("node").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            most = most_shared(batch.column(6).to_pylist(), batch.column(7).to_pylist())
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "rep_a", "rep_b"]).filter(pa.array((100 + percent) * most >= percent * n))

    with_sketches = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "rep_a", "rep_b", "n_a", "n_b", "sketch_a", "sketch_b")
    close = staged(with_sketches.mapInArrow(bounded, "a long, b long, rep_a struct<key:long,mark:long>, rep_b struct<key:long,mark:long>"), "close")
    wanted = close.select("a", "rep_a").union(close.select("b", "rep_b")).toDF("node", "rep").distinct()
    bits = spark.sparkContext.broadcast(bit_table(wanted.select(F.col("rep.mark").alias("value"))))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(bits.value, batch.column(1).to_numpy())))

    rows = docs.select(id_key().alias("key"), text_mark().alias("mark"), "text").mapInArrow(chosen, "key long, mark long, text string")
    texts = rows.join(wanted.select("node", "rep.key", "rep.mark"), ["key", "mark"]).select("node", "text").dropDuplicates(["node"])
    both = close.select("a", "b").join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, texts = batch.num_rows, as_bytes(batch.column(2)) + as_bytes(batch.column(3))
            number: dict[bytes, int] = {}
            own = [number.setdefault(t, len(number)) for t in texts]
            sets = []
            for i, j, shingle, doc in shingle_sets(list(number), width):
                sets += np.split(shingle, np.searchsorted(doc, np.arange(1, j - i)))
            both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(own[:m], own[m:], strict=True)], np.int64)
            total = np.array([len(sets[x]) + len(sets[y]) for x, y in zip(own[:m], own[m:], strict=True)], np.int64) - both
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((100 * both >= percent * total) & (both > 0)))

    return both.mapInArrow(work, "a long, b long")


def id_key() -> Column:
    """The id, null as the largest."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _linked(met: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the sets that have links."""

    def meets(level: Column) -> Column:
        """Whether sets of n and n_o, which must share ``overlap``, can count this meeting among their first ``level``."""
        overlap = F.ceil(percent * (F.col("n") + F.col("n_o")) / (100 + percent))
        return (
            (100 * F.least("n", "n_o") >= percent * F.greatest("n", "n_o"))
            & (F.col("place") < F.col("n") - overlap + level)
            & (F.col("place_o") < F.col("n_o") - overlap + level)
        )

    columns, level = ("node", "n", "place", "need", "part"), F.least("need", "need_o")
    links, labels, rows, expected = None, None, met.count(), None
    while True:
        if labels is None:
            now = met.withColumn("part", F.col("node"))
        else:
            now = met.join(labels, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        parts = now.groupBy("token", "part").agg(F.count("*").alias("k"))
        tokens = parts.groupBy("token").agg(F.max_by("part", F.struct("k", "part")).alias("largest"), F.sum("k").alias("all"), F.max("k").alias("most")).filter(F.col("all") > F.col("most"))
        tokens = staged(tokens, "tokens")
        before, expected = expected, tokens.agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0] or 0
        if expected <= ROWS_EACH * rows or (before is not None and expected > 0.8 * before):
            break
        # the most central set of a shingle and size band has the fewest rare shingles before it
        group = ["token", "band"]
        open_ = now.join(tokens.select("token"), "token")
        if links is not None:  # a pivot from another part than the one that has most
            open_ = open_.join(tokens.select("token", "largest"), "token")
            choice = open_.filter("part <> largest")
        else:
            choice = open_
        pivot = choice.groupBy(*group).agg(F.min_by(F.struct(*columns), F.struct("place", "node")).alias("p"))
        pivot = pivot.select(*group, *[F.col(f"p.{c}").alias(f"{c}_o") for c in columns])
        # a pair that may link is tried, also one near the threshold: left to the last turn, it would meet all of its group there
        star = open_.join(pivot, group).filter((F.col("part") != F.col("part_o")) & meets(level))
        pairs = star.groupBy("node", "node_o").agg(F.count("*").alias("shared"), F.max(level).alias("level")).filter("shared >= level")
        # of its pivots a set tries the one it shares most with and another, so that a turn has two pairs a set at most; later turns have the rest
        tried = pairs.groupBy("node").agg(F.max_by("node_o", F.struct("shared", "node_o")).alias("most"), F.max_by("node_o", F.xxhash64("node", "node_o")).alias("any"))
        tried = tried.select("node", F.explode(F.array("most", "any")).alias("node_o"))
        pairs = tried.select(F.least("node", "node_o").alias("a"), F.greatest("node", "node_o").alias("b")).distinct()
        found = staged(verified(staged(pairs, "pairs"), classes, docs, width, percent), "links")
        links = found if links is None else links.unionByName(found)
        labels = staged(components(links), "labels")
    largest = now.join(tokens.select("token", "largest"), "token").withColumn("outside", F.col("part") != F.col("largest")).drop("largest")
    outside = largest.filter("outside").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    other = largest.select("token", "band", *[F.col(c).alias(f"{c}_o") for c in (*columns, "outside")])
    once = ~F.col("outside_o") | (F.col("node") < F.col("node_o"))
    cross = outside.join(other, ["token", "band"]).filter((F.col("part") != F.col("part_o")) & once & meets(level))
    pairs = cross.groupBy(F.least("node", "node_o").alias("a"), F.greatest("node", "node_o").alias("b")).agg(F.count("*").alias("shared"), F.max(level).alias("level"))
    found = verified(staged(pairs.filter("shared >= level").select("a", "b"), "pairs"), classes, docs, width, percent)
    found = staged(found, "links")
    return staged(components(found if links is None else links.unionByName(found)), "labels")


def near_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, component (a struct of id key and mark): the smallest row reachable by links; null for empty sets."""
    counted = staged(set_table(docs, width), "sets")
    sets = counted.filter("kind = 0").select("doc_id", "mark", id_key().alias("key"), F.col("n").alias("n_shingles"), F.col("value").alias("node"), "sketch")
    repeats = counted.filter("kind = 1").groupBy("value").agg(F.sum("n").alias("n"))
    frequent = repeats.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "value").limit(MOST_FREQUENT).toArrow()
    bits = bit_table(counted.filter("kind = 1"))
    row = F.struct("key", "mark")
    classes = sets.filter("n_shingles > 0").groupBy("node").agg(F.min(row).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = staged(classes, "classes")
    met = staged(shared_only(prefix_table(docs, width, percent, frequent, bits)), "met")
    labels = _linked(met, classes, docs, width, percent)
    drop_staged(met)
    named = classes.select("node", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("first")), "component").select("node", F.col("first").alias("component"))
    return sets.drop("sketch", "key").join(named, "node", "left").select("doc_id", "mark", "n_shingles", "component")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links of at least ``percent`` % Jaccard."""
    rows = near_rows(docs, width, percent)
    first = F.when(F.col("component.key") != NO_ID, F.col("component.key"))
    return rows.select("doc_id", "n_shingles", F.coalesce(first, "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id (of equal ids, one text).

    Null, empty and blank texts stay.  Rows alike in id and text stay or go together.  Very long texts
    and ties have no rules of their own; an empty table gives no rows; other columns are carried.
    """
    rows = near_rows(docs, width, percent).select(id_key().alias("key"), "mark", "component")
    gone = rows.filter(F.struct("key", "mark") != F.col("component")).select("key", "mark").distinct()
    kept = docs.select(F.struct(*docs.columns).alias("row"), id_key().alias("key"), text_mark().alias("mark")).join(gone, ["key", "mark"], "left_anti")
    return kept.select("row.*")


def op8_adaptive_prefix_join(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=90)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * met >= 90 * (x.n + y.n - met)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS r, a AS o FROM e UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.o = e.a),
m AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN w ON w.r = reach.o GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, doc_id) AS component_id FROM w LEFT JOIN n ON n.r = w.r LEFT JOIN m ON m.r = w.r
"""
