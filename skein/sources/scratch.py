"""Tables written once between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs in one process."""
    where = spark.conf.get(KEY, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that all executors reach")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(KEY, where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}/{name}"
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(to.getParent())
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back, so that what several steps read is computed once and stays as it is."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
