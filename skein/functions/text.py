"""Column functions on text and JSON numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 80
#: Plain decimals, with neither exponent nor thousands separators.
DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"


def py_strip(c: Column) -> Column:
    """Trim every kind of Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column, max_chars: int = MAX_CHARS) -> Column:
    """Trim, make white space single blanks, and cut long text with a mark; null is empty."""
    flat = py_strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.char_length(flat) > max_chars, F.concat(F.substring(flat, 1, max_chars), F.lit("..."))).otherwise(flat)


def normalize_path_part(c: Column, max_chars: int = MAX_CHARS) -> Column:
    """Text that can stand in a dotted path: dots, also those of the cut mark, become underscores."""
    return F.replace(normalize_text(c, max_chars), F.lit("."), F.lit("_"))


def parse_numeric_text(c: Column) -> Column:
    """A double from plain decimal text, with a comma read as the decimal point; null for anything else."""
    plain = F.replace(py_strip(c), F.lit(","), F.lit("."))
    return F.when(plain.rlike(DECIMAL), plain.try_cast("double"))


def bucket_labels(base: int = 2, low: int = -1, high: int = 1024) -> list[str]:
    """Labels ``<base**e>_<base**(e+1)>`` of the exponents low..high-1, in short general notation."""
    return [f"{float(base) ** e:g}_{float(base) ** (e + 1) if (e + 1) * _log2(base) < 1024 else float('inf'):g}" for e in range(max(low, 0), high)]


def _log2(base: int) -> float:
    import math

    return math.log2(base)


def numeric_bucket(c: Column, base: int = 2) -> Column:
    """Signed power-of-``base`` bucket: zero, pos_lt_1, neg_lt_1, or sign and power range."""
    import math

    sign = F.when(c > 0, F.lit("pos_")).otherwise(F.lit("neg_"))
    most = int(1023 / math.log2(base)) + 1
    labels = F.array(*[F.lit(x) for x in bucket_labels(base, 0, most)])
    exponent = F.floor(F.log(float(base), F.abs(c))).cast("int")
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(None).cast("string"))
        .when(c == 0, F.lit("zero"))
        .when(F.abs(c) < 1, F.concat(sign, F.lit("lt_1")))
        .otherwise(F.concat(sign, F.get(labels, exponent)))
    )


def cleaned(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, normalize_text(F.col(column)))
