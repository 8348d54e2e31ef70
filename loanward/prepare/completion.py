"""Schema completion: add missing or empty columns with a default by name, then project."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanward.functions.keyed import bucket
from loanward.sources.schemas import DeclaredColumn

#: Name patterns and their defaults; the first match decides.
#: ``open_share`` and ``trade_share`` are parts of all_trades_count, ``by_type`` depends on
#: the declared type.
DEFAULTS_BY_NAME = (
    (r"_id", "null"),
    (r"(?=.*count)(?=.*(delinq|past_due))", 0),
    (r"(?=.*count)(?=.*inquir)", 1),
    (r"(?=.*count)(?=.*trade)(?=.*open)", "open_share"),
    (r"(?=.*count)(?=.*trade)", "trade_share"),
    (r"count", 0),
    (r"amount|balance|limit", 0.0),
    (r"ratio|pct", 0.0),
    (r"date", "null"),
    (r"(?=.*(flag|indicator))(?=.*match)", "Y"),
    (r"flag|indicator", False),
    (r"", "by_type"),
)


def _default(column: DeclaredColumn, has_trades: bool, position: Column) -> Column:
    lower = column.name.lower()
    value = next(v for pattern, v in DEFAULTS_BY_NAME if re.search(pattern, lower))
    if value == "open_share" and has_trades:
        # Between 60% and 90% of all trades, by row key.
        return (F.col("all_trades_count") * (F.lit(0.6) + F.lit(0.0003) * F.pmod(position, F.lit(1000)))).cast("int")
    if value in ("open_share", "trade_share"):
        return (F.col("all_trades_count") * F.lit(0.3)).cast("int") if has_trades else F.lit(3)
    if value == "by_type":
        numeric = "INT" in column.sql_type.upper() or "DECIMAL" in column.sql_type.upper()
        return F.lit(0).cast(column.type) if numeric and "VARCHAR" not in column.sql_type.upper() \
            else F.lit(None).cast(column.type)
    if value == "null":
        return F.lit(None).cast(column.type)
    return F.lit(value)


def empty_columns(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns that hold nulls only, from one aggregation over all of them."""
    if not columns:
        return set()
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c for i, c in enumerate(columns) if counts[i] == 0}


def complete_schema(df: DataFrame, declared: Sequence[DeclaredColumn], position: Column | None = None) -> DataFrame:
    """Fill declared columns that are absent or empty; columns with data stay as they are.

    ``position`` varies the filled trade counts between rows; by default it is a hash of
    the first declared column present.
    """
    present = set(df.columns)
    empty = empty_columns(df, [c.name for c in declared if c.name in present])
    fill = [c for c in declared if c.name not in present or c.name in empty]
    if not fill:
        return df
    if position is None:
        key = next((c.name for c in declared if c.name in present), None)
        position = bucket(key, 1000) if key else F.lit(0)
    has_trades = "all_trades_count" in present and "all_trades_count" not in {c.name for c in fill}
    return df.withColumns({c.name: _default(c, has_trades, position) for c in fill})


def project_schema(df: DataFrame, declared: Sequence[DeclaredColumn], cast: bool = False) -> DataFrame:
    """Declared order, other columns dropped; optionally cast to the declared types."""
    present = set(df.columns)
    return df.select([F.col(c.name).cast(c.type).alias(c.name) if cast else F.col(c.name)
                      for c in declared if c.name in present])


def hydrate(df: DataFrame, declared: Sequence[DeclaredColumn], position: Column | None = None) -> DataFrame:
    """Completion followed by projection; unchanged when nothing is declared."""
    return project_schema(complete_schema(df, declared, position), declared) if declared else df


def add_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({name: F.lit(v) for name, v in values.items()})


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename the columns that exist."""
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})
