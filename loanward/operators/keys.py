"""Key operators: orphans, existence, uniqueness, cardinality, parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.functions.sqltext import over
from loanward.operators.skew import skew_join


def _list(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def distinct_keys(df: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """The key values of a table, folded before the shuffle."""
    return df.select(*_list(keys)).distinct()


def key_counts(df: DataFrame, keys: Sequence[str] | str, name: str = "copies") -> DataFrame:
    """Rows per key.  Null keys form a group of their own."""
    return df.groupBy(*_list(keys)).agg(F.count(F.lit(1)).alias(name))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None,
            hot: Sequence = ()) -> DataFrame:
    """Child rows whose key is not in the parent; a null key is an orphan too."""
    known = parent.select(F.col(parent_key or key).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return skew_join(child, known, key, "left_anti", hot)


def holders(child: DataFrame, other: DataFrame, key: str, other_key: str | None = None,
            hot: Sequence = ()) -> DataFrame:
    """Child rows whose key does occur in the other table."""
    known = other.select(F.col(other_key or key).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return skew_join(child, known, key, "left_semi", hot)


def orphan_counts(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Orphan keys with their number of child rows; both sides are folded by key first."""
    return orphans(key_counts(child, key, "violations"), parent, key, parent_key)


def duplicate_groups(df: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Keys that occur more than once."""
    return key_counts(df, keys).filter(F.col("copies") > 1)


def surplus_rows(df: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """One row: rows beyond the first of each key, that is rows minus distinct keys."""
    return key_counts(df, keys).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("violations"))


def cardinality(parent: DataFrame, child: DataFrame, key: str, child_key: str | None = None) -> DataFrame:
    """Distinct parent keys with their number of child rows, zero included."""
    counts = key_counts(child.select(F.col(child_key or key).alias(key)), key, "children")
    return (distinct_keys(parent, key).join(counts, key, "left")
            .withColumn("children", F.coalesce("children", F.lit(0)).cast("long")))


def row_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row with the row counts of two tables."""
    return over({"a": left, "b": right},
                "SELECT (SELECT count(*) FROM {a}) AS n_left, (SELECT count(*) FROM {b}) AS n_right")


def key_parity(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """One row with the distinct key counts of two tables; null counts as a value."""
    return row_parity(distinct_keys(left, left_key), distinct_keys(right, right_key or left_key))
