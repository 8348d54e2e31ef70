"""Per-key anchors: first and last dates, sums and counts under a condition."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanward.functions.sqltext import over


def anchors(df: DataFrame, key: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row per key with the given aggregates; combined on the map side."""
    return df.groupBy(key).agg(*[c.alias(name) for name, c in measures.items()])


def max_where(column: str, condition: str) -> Column:
    return F.max(F.when(F.expr(condition), F.col(column)))


def min_where(column: str, condition: str) -> Column:
    return F.min(F.when(F.expr(condition), F.col(column)))


def count_where(condition: str) -> Column:
    return F.count(F.when(F.expr(condition), F.lit(1)))


def at_latest(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` equals the table's maximum.

    The maximum is a scalar subquery, so it filters the scan and prunes partitions.
    """
    return over({"rows": df}, f"SELECT * FROM {{rows}} WHERE `{column}` = (SELECT max(`{column}`) FROM {{rows}})")


def in_latest_month(df: DataFrame, column: str) -> DataFrame:
    """Rows whose date lies in the month of the latest one; the bound on the plain column reaches the scan."""
    return over({"rows": df}, f"SELECT * FROM {{rows}} WHERE `{column}` >= "
                              f"(SELECT date_trunc('MONTH', max(`{column}`)) FROM {{rows}})")
