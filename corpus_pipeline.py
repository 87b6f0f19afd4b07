"""From raw documents to mixed, encoded training data in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written and read again.  All but the last return the columns of ``documents``.

An empty table passes through all stages.  Null, empty and blank texts are clean, no copies of anything,
hold no repeats, and are not mixed, as they have no words.  Rows alike in id and text stay together up
to the mix, which takes each by its own plan.  Ties fall to the smaller id, then to a hash of the text.
Texts of any length are worked on whole; columns with names of the stages' own are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bytebpe, curriculum, ngramjoin, suffixdedup, toxicity
from skein.llm.staging import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below its threshold."""
    return toxicity.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more."""
    return ngramjoin.one_of_each(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document holds; n_chars follows the text."""
    cut = suffixdedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in cut.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return curriculum.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts."""
    return bytebpe.encoded(docs, keep_text=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]
#: Trained models and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
