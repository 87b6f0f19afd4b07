from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.timing import hash_split, rounded_long, time_gap_id
from skein.functions.vectors import clip_probability, entropy, l2_normalize


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_time_gap(spark):
    gaps = [-5, 0, 1, 2, 10, 11, 60, 61, 300, 301, 3600, 3601, 21600, 21601, 86400, 86401, 604800, 604801]
    assert column(spark, gaps, "long", time_gap_id) == [0, 0, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9]


def test_numbers_and_buckets(spark):
    assert column(spark, ["1,5", " -2 ", "1e5", "1,234.5", ".5", "", None], "string", X.parse_numeric_text) == [1.5, -2.0, None, None, 0.5, None, None]
    assert column(spark, [0.0, 0.5, -0.5, 1.0, 3.0, -8.0, 1048576.0, None], "double", X.numeric_bucket) == [
        "zero", "pos_lt_1", "neg_lt_1", "pos_1_2", "pos_2_4", "neg_8_16", "pos_1.04858e+06_2.09715e+06", None,
    ]


def test_text(spark):
    assert column(spark, ["a" * 81, "  a \n b ", " x　", None], "string", X.normalize_text) == ["a" * 80 + "...", "a b", "x", ""]
    assert column(spark, ["a" * 81, "a.b"], "string", X.normalize_path_part) == ["a" * 80 + "___", "a_b"]


def test_vectors(spark):
    assert column(spark, [[3.0, 4.0], [0.0, 0.0]], "array<double>", l2_normalize) == [[0.6, 0.8], [0.0, 0.0]]
    assert [round(x, 6) for x in column(spark, [[0.5, 0.5], [1.0, 0.0]], "array<double>", entropy)] == [0.693147, 0.0]
    assert column(spark, [0.0, 1.0, 0.5], "double", clip_probability) == [1e-6, 1 - 1e-6, 0.5]
    assert column(spark, [0.5, 1.5, 2.5, -0.5], "double", rounded_long) == [0, 2, 2, 0]


def test_hash_split_ratios(spark):
    counts = {r[0]: r[1] for r in spark.range(20000).select(hash_split(F.col("id").cast("string")).alias("s")).groupBy("s").count().collect()}
    assert abs(counts["train"] / 20000 - 0.70) < 0.02 and abs(counts["valid"] / 20000 - 0.15) < 0.02
