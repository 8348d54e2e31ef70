"""Values that look random but depend only on the row's key, so reruns agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bucket(key: Column | str, buckets: int, salt: str = "") -> Column:
    """Bucket number 0 .. buckets-1 from a hash of the key."""
    return F.pmod(F.xxhash64(_c(key), F.lit(salt)), F.lit(buckets)).cast("int")


def in_band(position: Column, low: int, high: int) -> Column:
    """Map a non-negative integer onto [low, high]."""
    return (F.lit(low) + F.pmod(position, F.lit(high - low + 1))).cast("int")


def weighted_choice(position: Column, choices: Sequence[tuple[object, int]]) -> Column:
    """Pick by cumulative integer weights; ``position`` is taken modulo their sum."""
    total = sum(weight for _, weight in choices)
    slot = F.pmod(position, F.lit(total))
    out, reached = None, 0
    for value, weight in choices:
        reached += weight
        test = slot < F.lit(reached)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out
