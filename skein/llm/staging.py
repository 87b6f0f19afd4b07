"""Tables written between jobs, so that a lost executor never repeats a long lineage; and bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import staged  # noqa: F401  (used by the operators)

BATCH_BYTES = 2 << 20


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later job reads."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            to = spark._jvm.org.apache.hadoop.fs.Path(file).getParent().getParent()
            if to.getName().startswith("skein-"):
                to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches handed to Python by bytes, as texts vary from one word to megabytes; one bound for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
