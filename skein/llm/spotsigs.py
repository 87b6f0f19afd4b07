"""Document fingerprints from spot signatures, with SQL functions only.

A signature is a run of common words (the anchor) with the chain of the next two other words.  The
fingerprint of a text is its set of signatures as sorted 32-bit hashes, written in hex.  Likeness is
the Jaccard similarity of two sets; sets are partitioned by length, as sets of lengths a < b reach
at most a / b, and pairs beyond that bound are dropped unseen.

One word in ``SPARE`` is an anchor by its hash.  A text without any anchor gets chains of two from every word; one without letters or digits is one
signature of its own characters; null is the empty text.  Equal texts have equal fingerprints and
likeness 1.  Repeated ids are ordered by text; null ids come first.  An empty table gives no rows.
Very long texts are one row of arrays like others; columns other than id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Anchors: articles, pronouns, prepositions and auxiliaries of four languages.
ANCHORS = """
a an the this that these those of to in on at by for from with as and or is are was were be been it he she they
der die das den dem des ein eine und oder ist sind war von zu mit auf im am sich nicht auch
le la les un une des du de et ou est sont dans pour par sur que qui ne pas
el los las una y o es son en por para con del se lo su
""".split()
#: Rows that one window of neighbouring ids should hold, and the most windows.
WINDOW_ROWS, MOST_WINDOWS = 512, 1 << 16
CHAIN_MARK = "_"
#: One word in so many, by its hash, is an anchor too, so that texts with few common words have signatures.
SPARE = 8


def _content(unit: Column) -> Column:
    return F.substring_index(unit, CHAIN_MARK, -1)


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the sorted distinct signature hashes of a non-null text column."""
    plain, units, spots = f"{out}_plain", f"{out}_units", f"{out}_spots"
    anchors = "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w)))
    df = df.withColumn(plain, F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")))
    df = df.withColumn(units, F.split(F.regexp_replace(plain, rf"(?<=^| )({anchors}) ", f"$1{CHAIN_MARK}"), " "))
    following = F.slice(units, F.lit(2), F.greatest(F.size(units), F.lit(1)))
    at_anchor = F.zip_with(units, following, lambda a, b: F.when(F.contains(a, F.lit(CHAIN_MARK)) | (F.pmod(F.hash(a), F.lit(SPARE)) == 0), F.hash(a, _content(b))))
    df = df.withColumn(spots, F.array_compact(at_anchor))
    every = F.zip_with(units, following, lambda a, b: F.hash(a, b))
    chosen = F.when(F.size(spots) > 0, F.col(spots)).when(F.length(plain) > 0, every).otherwise(F.array(F.hash(text)))
    return df.withColumn(out, F.array_sort(F.array_distinct(chosen))).drop(plain, units, spots)


def fingerprint(sig: str) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def jaccard(a: str, b: str) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.round(common / (F.size(a) + F.size(b) - common), 6)


def length_band(sig: str, threshold: float) -> Column:
    """Partition by set length: sets that reach the threshold are in the same band or a neighbouring one."""
    return F.floor(F.log(F.size(sig).cast("double")) / -math.log(threshold)).cast("int")


def _window_number(docs: DataFrame) -> Column:
    """Number of the range of ids that holds a row; ranges hold about ``WINDOW_ROWS`` rows each.

    Quantiles of the ids, at most ``MOST_WINDOWS``, are searched in two levels.
    """
    rows = docs.count()
    side = max(1, math.isqrt(min(MOST_WINDOWS, rows // WINDOW_ROWS)))
    total = side * side
    at = [k / total for k in range(1, total)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, 10_000).alias("q")).first().q if at and rows else None
    if not cuts:
        return F.lit(0)
    coarse = cuts[side - 1 :: side]
    fine = [cuts[k * side : k * side + side - 1] for k in range(side)]
    below = lambda values: F.coalesce(F.size(F.filter(values, lambda c: c < F.col("doc_id"))), F.lit(0))
    longs = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values]) if values else F.array().cast("array<long>")
    first = below(longs(coarse))
    return first * side + below(F.element_at(F.array(*[longs(v) for v in fine]), first + 1))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sig and the next document's text and sig in ascending id; after the last comes the first.

    Texts move once, to windows of neighbouring ids; only the last row of each window is joined.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number = _window_number(docs.select("doc_id"))
    order = Window.partitionBy("window").orderBy(F.asc_nulls_first("doc_id"), "text")
    placed = with_signatures(rows.withColumn("window", number), "text", "sig")
    placed = (
        placed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sig", F.lead("sig").over(order)).withColumn("nth", F.row_number().over(order))
    )
    inner = placed.filter(F.col("next_text").isNotNull())
    ends = placed.filter(F.col("next_text").isNull()).select("window", "doc_id", "text", "sig")
    heads = placed.filter("nth = 1").select(F.col("window").alias("next_window"), F.col("text").alias("next_text"), F.col("sig").alias("next_sig"))
    windows = docs.select("doc_id").select(number.alias("window")).distinct()
    everywhere = Window.partitionBy(F.lit(0)).orderBy("window")
    follow = windows.withColumn("next_window", F.coalesce(F.lead("window").over(everywhere), F.first("window").over(everywhere)))
    outer = ends.join(follow, "window").join(heads, "next_window")
    columns = ["doc_id", "text", "sig", "next_text", "next_sig"]
    return inner.select(columns).unionByName(outer.select(columns))


def edited_fingerprints(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to that and to the next document."""
    df = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - tail), F.substring("next_text", F.lit(1), tail))
    df = with_signatures(df.withColumn("edited", edited), "edited", "edited_sig")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("sig").alias("fingerprint"),
        fingerprint("edited_sig").alias("edited_fingerprint"),
        jaccard("sig", "edited_sig").alias("near_edited"),
        jaccard("sig", "next_sig").alias("near_next"),
        F.size("sig").alias("n_signatures"),
        length_band("sig", threshold).alias("length_band"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of fingerprint classes with likeness of at least the threshold: (class_a, class_b, likeness).

    A class is the smallest id of the documents with one signature set; ``fingerprint_classes`` has
    the members.  Sets meet on a signature of their rarest part: two sets that reach the threshold
    share one of the ``n - ceil(threshold * n) + 1`` rarest.  Only pairs of neighbouring length
    bands are compared.
    """
    classes = fingerprint_classes(docs).groupBy("sig").agg(F.min("class_id").alias("class_id"))
    classes = classes.withColumn("band", length_band("sig", threshold))
    spread = classes.select("class_id", F.explode("sig").alias("s"))
    common = spread.groupBy("s").agg(F.count("*").alias("n"))
    ranked = spread.join(common, "s").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("by_rarity"))
    n = F.size("by_rarity")
    prefix = F.slice("by_rarity", F.lit(1), (n - F.ceil(threshold * n - 1e-9) + 1).cast("int"))
    keyed = ranked.withColumn("s", F.explode(F.transform(prefix, lambda x: x["s"]))).select("class_id", "s").join(classes.select("class_id", "band", F.size("sig").alias("n")), "class_id")
    keyed = keyed.select("class_id", "s", "n", "band")
    left = keyed.select(F.col("class_id").alias("class_a"), "s", F.col("n").alias("n_a"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    right = keyed.select(F.col("class_id").alias("class_b"), "s", F.col("n").alias("n_b"), "band")
    met = left.join(right, ["s", "band"]).filter(
        ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("class_a") < F.col("class_b")))) & (F.col("n_a") >= threshold * F.col("n_b"))
    )
    pairs = met.select("class_a", "class_b").distinct()
    a = classes.select(F.col("class_id").alias("class_a"), F.col("sig").alias("sig_a"))
    b = classes.select(F.col("class_id").alias("class_b"), F.col("sig").alias("sig_b"))
    likeness = pairs.join(a, "class_a").join(b, "class_b").withColumn("likeness", jaccard("sig_a", "sig_b"))
    return likeness.filter(F.col("likeness") >= threshold).select("class_a", "class_b", "likeness")


def fingerprint_classes(docs: DataFrame) -> DataFrame:
    """doc_id, its signature set, and class_id: the smallest id with that set."""
    sigs = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sig").drop("text")
    ids = sigs.groupBy("sig").agg(F.min("doc_id").alias("class_id"))
    return sigs.join(ids, "sig").select("doc_id", "class_id", "sig")


def op1_spot_signatures(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
