"""Incremental runs: skipped, redone, and picked up after a run that died."""

import pytest
from pyspark.sql import functions as F

from skein.streaming import manifest


def test_shards_are_done_once_and_again_when_they_change(spark, tmp_path):
    for name, n in (("a", 5), ("b", 7)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    keep = lambda df, how: df.filter(F.col("id") >= how["least"]).withColumn("bad", F.when(F.col("id") == 4, "four"))

    def run(least=1, **more):
        report = manifest.run_incremental(spark, f"{tmp_path}/in/*/*.parquet", keep, {"least": least}, f"{tmp_path}/out", f"{tmp_path}/manifest", errors="bad", **more)
        return sorted((r.shard.split("/in/")[1][0], r.status, r.rows_in, r.rows_out, r.parse_errors) for r in report.collect())

    assert run() == [("a", "processed", 5, 4, 1), ("b", "processed", 7, 6, 1)]
    assert run() == [("a", "skipped_existing", 5, 4, 1), ("b", "skipped_existing", 7, 6, 1)]
    spark.range(3).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / "a"))  # a new file in place of the old
    assert run() == [("a", "processed", 3, 2, 0), ("b", "skipped_existing", 7, 6, 1)]
    assert run(least=6) == [("a", "redone", 3, 0, 0), ("b", "redone", 7, 1, 0)]
    assert [r.id for r in manifest.read_output(spark, f"{tmp_path}/out", f"{tmp_path}/manifest", f"{tmp_path}/in/*/*.parquet").collect()] == [6]
    assert [r[1] for r in run(least=6, overwrite=True)] == ["redone", "redone"]

    def dies(df, how):
        return keep(df, how).withColumn("x", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        manifest.run_incremental(spark, f"{tmp_path}/in/*/*.parquet", dies, {"least": 2}, f"{tmp_path}/out", f"{tmp_path}/manifest")
    assert [r.id for r in manifest.read_output(spark, f"{tmp_path}/out", f"{tmp_path}/manifest", f"{tmp_path}/in/*/*.parquet").collect()] == [6]
    assert [r[1] for r in run(least=2)] == ["redone", "redone"]
