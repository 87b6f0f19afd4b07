"""Ranked lexical search with pipelined term partitioning.

The terms of the items are dealt to ``OWNERS`` term owners by falling weight.  Documents are dealt to shards of
bounded size, and each item travels as one bundle a shard: a sparse table of document scores.  At each owner
the bundles of a shard meet the owner's postings in a cogroup, which adds integer contributions; after the last
owner every bundle gives its best documents, and the best of all shards are selected.

Bundles stay sparse without losing a result: a document leaves when even the largest possible contributions of
the owners to come cannot lift it to the score that ``k`` documents of the bundle already have, and when no
unseen document could get there, only those in the bundle are scored further.

Null or empty texts, and texts without terms, match nothing and count in no statistic but their own absence.
Repeated documents are documents of their own, repeated items items of their own.  Equal scores go by id, a null
id last.  Without items or documents there are no rows.  Other columns are ignored.  Long texts are read a piece
at a time; memory follows their distinct terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import small_batches, staged
from .textbytes import as_bytes

#: On bytes, as every byte of a longer UTF-8 character is above 0x7F.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
PIECE = 1 << 20
OWNERS = 4
#: Bytes of item texts whose terms are searched together, items in one slice of bundles, documents in a shard.
ITEM_BYTES, ITEMS, SHARD = 4 << 20, 256, 4096
NO_ID = (1 << 63) - 1
POSTINGS = "row long, doc_id long, n long, terms array<int>, counts array<int>"
BUNDLES = "shard int, slice int, item int, rows array<long>, docs array<long>, scores array<long>"
OWNED = "row long, doc_id long, terms array<int>, parts array<int>"


def term_counts(text: bytes) -> Counter[bytes]:
    """Occurrences of each term, with A-Z in lower case."""
    out, at = Counter(), 0
    while at < len(text):
        cut = BETWEEN.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        out.update(TERM.findall(text[at:end].lower()))
        at = end
    return out


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _joined(arrays: list[np.ndarray]) -> pa.ListArray:
    """One list an array."""
    ends = np.append(0, np.cumsum([len(x) for x in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)))


def item_terms(items: DataFrame) -> DataFrame:
    """(row, item_id, block, terms): distinct terms of each item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(term_counts(t)) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(terms, pa.binary())], names=["row", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), "text")
    found = rows.mapInArrow(work, "row long, item_id long, terms array<binary>")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return found.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(1 + total // ITEM_BYTES)))


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """For every document its number of terms, and the known ones with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            size, terms, counts = [], [], []
            for text in as_bytes(batch.column(2)):
                found = term_counts(text)
                own = sorted((known[t], found[t]) for t in found.keys() & known.keys())
                size.append(found.total())
                terms.append([x for x, _ in own])
                counts.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), _lists(terms, pa.int32()), _lists(counts, pa.int32())], names=["row", "doc_id", "n", "terms", "counts"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.mapInArrow(work, POSTINGS)


def _part(count, m):
    """What an occurrence count gives per unit of weight."""
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


class Model:
    """Weights, largest contributions and owners of the terms of one block of items."""

    def __init__(self, held: DataFrame, terms: int, owners: int):
        sums = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
        self.docs, self.all, self.owners = sums.docs, max(1, sums.all), owners
        pair = F.explode(F.arrays_zip("terms", "counts")).alias("x")
        each = held.select(F.expr(f"10L + (90L * n * {self.docs}L) div {self.all}L").alias("m"), pair)
        most = F.max(F.expr("(1000000000L * x.counts) div (1000L * x.counts + 8L * m)"))
        rows = each.groupBy("x.terms").agg(F.count("*").alias("df"), most.alias("most")).toArrow()
        term, df = rows.column(0).to_numpy(), np.zeros(terms, np.int64)
        self.most = np.zeros(terms, np.int64)
        df[term], self.most[term] = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        self.weight = np.floor(1000 * np.log((2 * self.docs + 2) / (2 * df + 1))).astype(np.int64)
        self.most *= self.weight
        order = np.lexsort((np.arange(terms), -self.weight))
        # owners hold about as many postings each, the heaviest terms first
        before = np.cumsum(df[order]) - df[order]
        self.owner = np.zeros(terms, np.int64)
        self.owner[order] = np.minimum(owners - 1, before * owners // max(1, df.sum()))


def owned(held: DataFrame, model: Model, owner: int) -> DataFrame:
    """The postings of one owner's terms, with what each gives per unit of weight."""
    shared, docs, every = held.sparkSession.sparkContext.broadcast((model.owner == owner) & (model.weight > 0)), model.docs, model.all

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            lists, n = batch.column(3), batch.column(2).to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            at = np.repeat(np.arange(len(size)), size)
            term, count = lists.flatten().to_numpy(), batch.column(4).flatten().to_numpy().astype(np.int64)
            keep = mine[term]
            term, count, at = term[keep], count[keep], at[keep]
            part = _part(count, 10 + (90 * n[at] * docs) // every)
            held_by = np.bincount(at, minlength=len(size))
            some = np.flatnonzero(held_by)
            ends = pa.array(np.append(0, np.cumsum(held_by[some])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, part)]
            pick = pa.array(some)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *lists], names=["row", "doc_id", "terms", "parts"])

    return held.mapInArrow(work, OWNED)


def _level(scores: np.ndarray, k: int) -> int:
    """The k-th highest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def add(bundles: pa.Table, posts: pa.Table, items: list[tuple[int, np.ndarray]], model: Model, owner: int, k: int) -> pa.Table:
    """The bundles of one shard after one owner."""
    last = owner == model.owners - 1
    lists = posts.column("terms").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    in_bundles = bundles.column("rows").combine_chunks().flatten().to_numpy()
    rows, first = np.unique(np.concatenate([posts.column("row").to_numpy(), in_bundles]), return_index=True)
    docs = np.concatenate([posts.column("doc_id").to_numpy(), bundles.column("docs").combine_chunks().flatten().to_numpy()])[first]
    at = np.repeat(np.searchsorted(rows, posts.column("row").to_numpy()), size)
    term, part = lists.flatten().to_numpy(), posts.column("parts").combine_chunks().flatten().to_numpy().astype(np.int64)
    order = np.argsort(term, kind="stable")
    term, part, at = term[order], part[order], at[order]
    begin, end = (np.searchsorted(term, np.arange(len(model.owner)), side) for side in ("left", "right"))
    carried = {}
    ends = bundles.column("rows").combine_chunks().offsets.to_numpy()
    sums = bundles.column("scores").combine_chunks().flatten().to_numpy()
    for x, (a, b) in zip(bundles.column("item").to_pylist(), zip(ends, ends[1:], strict=False), strict=True):
        carried[x] = (np.searchsorted(rows, in_bundles[a - ends[0] : b - ends[0]]), sums[a - ends[0] : b - ends[0]])
    none = np.zeros(0, np.int64)
    out: list[tuple] = []
    for item, terms in items:
        known, score = carried.get(item, (none, none))
        total = np.zeros(len(rows), np.int64)
        total[known] = score
        to_come = int(model.most[terms[model.owner[terms] >= owner]].sum())
        closed = to_come < _level(score, k)
        for t in terms[model.owner[terms] == owner].tolist():
            total[at[begin[t] : end[t]]] += model.weight[t] * part[begin[t] : end[t]]
        own = known if closed else np.flatnonzero(total)
        score = total[own]
        left = int(model.most[terms[model.owner[terms] > owner]].sum())
        keep = score + left >= max(1, _level(score, k))
        own, score = own[keep], score[keep]
        if last and len(own) > k:
            best = np.lexsort((rows[own], docs[own], -score))[:k]
            own, score = own[best], score[best]
        if len(own):
            out.append((item, rows[own], docs[own], score))
    n = len(out)
    item, *cols = zip(*out, strict=True) if out else [()] * 4
    place = (posts if len(posts) else bundles).select(["shard", "slice"]).slice(0, 1)
    key = [pa.array([place.column(c)[0].as_py()] * n, pa.int32()) for c in ("shard", "slice")]
    return pa.table([*key, pa.array(item, pa.int32()), *(_joined(list(c)) for c in cols)], names=[x.split()[0] for x in BUNDLES.split(", ")])


def search(docs: DataFrame, items: DataFrame, k: int = 10, owners: int = OWNERS) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    small_batches(spark)
    items = staged(item_terms(items), "items")
    found = [_block(docs, items.filter(F.col("block") == r.block), k, owners) for r in items.select("block").distinct().orderBy("block").collect()]
    out = found[0] if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _block(docs: DataFrame, block: DataFrame, k: int, owners: int) -> DataFrame:
    """Results of one block of items, whose texts, and so whose terms, are about ``ITEM_BYTES``."""
    spark = docs.sparkSession
    rows = block.orderBy("row").toArrow()
    lists = rows.column("terms").to_pylist()
    known = {t: i for i, t in enumerate(sorted({t for own in lists for t in own}))}
    items = [(i, np.array(sorted(known[t] for t in own), np.int64)) for i, own in enumerate(lists)]
    slices = 1 + len(items) // ITEMS
    held = staged(postings(docs, known), "postings")
    model = Model(held, len(known), owners)
    shards = max(12, model.docs // SHARD)
    shared = spark.sparkContext.broadcast((items, model))
    bundles = spark.createDataFrame([], BUNDLES)

    def at_owner(owner: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def work(bundles: pa.Table, posts: pa.Table) -> pa.Table:
            items, model = shared.value
            mine = int((posts if len(posts) else bundles).column("slice")[0].as_py())
            return add(bundles, posts, items[mine::slices], model, owner, k)

        return work

    for owner in range(owners):
        posts = owned(held, model, owner).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        pairs = bundles.repartition(shards, "shard", "slice").groupBy("shard", "slice").cogroup(posts.repartition(shards, "shard", "slice").groupBy("shard", "slice"))
        bundles = pairs.applyInArrow(at_owner(owner), BUNDLES)
    hits = bundles.select("item", F.explode(F.arrays_zip("rows", "docs", "scores")).alias("x")).select("item", "x.*")
    order = Window.partitionBy("item").orderBy(F.desc("scores"), "docs", "rows")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(items)), pa.int32()), "item_id": rows.column("item_id")}))
    doc_id = F.when(F.col("docs") < NO_ID, F.col("docs"))
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", doc_id.alias("doc_id"), F.col("scores").alias("score"))


def op13_pipelined_term_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
z AS (SELECT count(*) FILTER (len(t) > 0) AS docs, sum(len(t))::BIGINT AS every FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, z GROUP BY term, docs),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS t FROM benchmark),
q AS (SELECT i, item_id, unnest(t) AS term FROM i),
s AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // every))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN f USING (term), z GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
