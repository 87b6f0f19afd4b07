"""Many-to-one joins whose crowded keys are spread over many tasks.

Crowded keys are found by a frequent-items sketch, a mergeable aggregate of bounded size.  Their rows on the left
get a salt from a hash of the whole row, their one row on the right a copy for each salt; all other keys keep salt 0.
Only hashes of crowded keys are broadcast, at most ``HEAVY`` of them; a chance collision of hashes salts a key more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most crowded keys, each with at least this share (1 / HEAVY) of all rows; items the sketch tracks for each.
HEAVY, TRACKED = 256, 16
#: Salts for each shuffle partition, several so that their hashes fill the partitions evenly.
SALTS = 8


def heavy_keys(df: DataFrame, column: str) -> DataFrame:
    """Hashes (``heavy``) of the keys that hold at least one in ``HEAVY`` rows of ``df``."""
    keys = df.select(F.xxhash64(column).alias("key"))
    top = keys.agg(F.expr(f"approx_top_k(key, {HEAVY}, {HEAVY * TRACKED})").alias("top"), F.count("*").alias("rows"))
    return top.select("rows", F.explode("top").alias("x")).filter(F.col("x.count") * HEAVY >= F.col("rows")).select(F.col("x.item").alias("heavy"))


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """``left`` joined (inner or left) to ``right``, which has one row a key; ``heavy`` holds hashes of crowded keys."""
    salts = SALTS * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast((heavy if heavy is not None else heavy_keys(left, on)).limit(HEAVY))
    marked = lambda df: df.join(heavy, F.xxhash64(F.col(on)) == F.col("heavy"), "left")
    crowded = F.col("heavy").isNotNull()
    hashed = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    spread = F.when(crowded, F.pmod(F.xxhash64(*hashed), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(crowded, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = marked(left).select(*left.columns, spread.alias("__salt"))
    copied = marked(right).select(*right.columns, F.explode(copies).alias("__salt"))
    return salted.join(copied, [on, "__salt"], how).drop("__salt")
