"""Column functions on times, gaps and splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
#: Upper bounds in seconds of the gap buckets 1..8; up to 0 is bucket 0, beyond the last is 9.
GAP_BOUNDS = (1, 10, 60, 300, 3_600, 21_600, 86_400, 604_800)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-free timestamp, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def time_gap_id(delta: Column) -> Column:
    out = F.when(delta <= 0, 0)
    for k, bound in enumerate(GAP_BOUNDS, start=1):
        out = out.when(delta <= bound, k)
    return out.otherwise(len(GAP_BOUNDS) + 1)


def hash_share(user: Column, seed: int = 42) -> Column:
    """A uniform number in [0, 1) from the user and the seed."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), user), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(2**52)


def hash_split(user: Column, train: float = 0.70, valid: float = 0.15, seed: int = 42) -> Column:
    u = hash_share(user, seed)
    return F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test")


def rounded_long(c: Column) -> Column:
    """Double to bigint by rounding halves to even, as engines that round on cast do."""
    return F.rint(c).cast("long")
