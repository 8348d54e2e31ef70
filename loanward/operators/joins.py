"""Joins between a fact and a dimension, with folding of repeated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.operators.skew import skew_join


def fold(df: DataFrame, count: str = "_n") -> DataFrame:
    """Distinct rows with their multiplicity.  Copies collapse before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count))


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename all columns but ``keep``, so that a join has no clashing names."""
    return df.select([F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def joined(left: DataFrame, right: DataFrame, on: Sequence[str] | str, prefix: str,
           hot: Sequence = (), how: str = "inner") -> DataFrame:
    """Left rows with the matching right rows, right columns prefixed."""
    keys = [on] if isinstance(on, str) else list(on)
    return skew_join(left, prefixed(right, prefix, keys), keys, how, hot)


def weighted_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, prefix: str,
                  fold_left: bool = True, fold_right: bool = False, hot: Sequence = ()) -> DataFrame:
    """Inner join that carries ``_n``, the number of row pairs an output row stands for.

    Folding a side first keeps the output linear where a key is frequent on both sides.
    """
    keys = [on] if isinstance(on, str) else list(on)
    one = F.lit(1).cast("long")
    a = fold(left, "_nl") if fold_left else left.withColumn("_nl", one)
    b = prefixed(right, prefix, keys)
    b = fold(b, "_nr") if fold_right else b.withColumn("_nr", one)
    out = skew_join(a, b, keys, "inner", hot)
    return out.withColumn("_n", F.col("_nl") * F.col("_nr")).drop("_nl", "_nr")
