"""What Parquet footers tell without a scan: rows, nulls and bounds of columns, and rules that follow from them.

The aggregates are pushed into the source, so only footers are read. A rule on a column's range or nulls that holds
for the bounds holds for the table. What bounds leave open is counted in one scan whose filter is pushed as well, so
row groups that lie inside all asked ranges stay unread.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column types whose bounds footers hold exactly and Spark takes from there.
BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.BooleanType)
#: Columns asked for in one aggregate.
COLUMNS_PER_PASS = 60
_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def _pushing(spark: SparkSession) -> Iterator[None]:
    """While the block runs, Parquet is read by the source that takes aggregates."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass(frozen=True)
class Facts:
    """Rows of a table and, by column, its nulls and bounds; bounds are None where footers hold none."""

    rows: int
    nulls: dict[str, int]
    low: dict[str, object]
    high: dict[str, object]
    from_footers: bool


def _aggregate(df: DataFrame, columns: Sequence[T.StructField]) -> DataFrame:
    out = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        name = f"`{c.name}`"
        out.append(F.count(name).alias(f"c{i}"))
        if isinstance(c.dataType, BOUNDED):
            out += [F.min(name).alias(f"l{i}"), F.max(name).alias(f"h{i}")]
    return df.agg(*out)


def pushed(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> str:
    """The plan by which ``column_facts`` reads; ``PushedAggregation`` lists what footers answer."""
    with _pushing(spark):
        df = spark.read.parquet(path)
        wanted = [f for f in df.schema.fields if columns is None or f.name in columns]
        return _aggregate(df, wanted)._jdf.queryExecution().toString()


def column_facts(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> Facts:
    """Facts of a Parquet table, by one row for each COLUMNS_PER_PASS columns.

    Files without statistics, and columns for which the source takes no aggregate, are scanned instead: the facts are
    the same, but for NaN, which footers leave out of the bounds. Nested columns have nulls and no bounds.
    """
    fields = [f for f in spark.read.parquet(path).schema.fields if columns is None or f.name in columns]
    nested = [f for f in fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    flat = [f for f in fields if f not in nested]
    rows, nulls, low, high, footers = 0, {}, {}, {}, not nested
    parts = [flat[i:i + COLUMNS_PER_PASS] for i in range(0, max(1, len(flat)), COLUMNS_PER_PASS)] + ([nested] if nested else [])
    for part in parts:
        row, pushed_down = _first(spark, path, part)
        footers = footers and pushed_down
        rows = row["n"] or 0  # files without row groups give no counts
        for i, f in enumerate(part):
            nulls[f.name] = rows - (row[f"c{i}"] or 0)
            bounded = isinstance(f.dataType, BOUNDED)
            low[f.name], high[f.name] = (row[f"l{i}"], row[f"h{i}"]) if bounded else (None, None)
    return Facts(rows, nulls, low, high, footers)


def _first(spark: SparkSession, path: str, columns: Sequence[T.StructField]) -> tuple[T.Row, bool]:
    try:
        with _pushing(spark):
            asked = _aggregate(spark.read.parquet(path), columns)
            plan = asked._jdf.queryExecution().toString()
            return asked.first(), "PushedAggregation: [COUNT" in plan
    except (PySparkException, Py4JJavaError) as error:
        if "aggregatePushdown" not in str(error):  # Spark's word for a footer without the statistics
            raise
    return _aggregate(spark.read.parquet(path), columns).first(), False


@dataclass(frozen=True)
class Bound:
    """A row breaks the bound if its value is under ``low`` or over ``high``, or null where that is not allowed."""

    column: str
    low: float | int | None = None
    high: float | int | None = None
    nulls: bool = True

    def broken(self, floating: bool = False) -> str:
        """SQL for a row that breaks the bound. In floating columns NaN is asked for by name: statistics, by which
        row groups are left out, don't show it."""
        name = f"`{self.column}`"
        parts = [f"{name} < {self.low}"] if self.low is not None else []
        parts += [f"{name} > {self.high}"] if self.high is not None else []
        parts += [f"isnan({name})"] if floating and self.high is not None else []
        parts += [] if self.nulls else [f"{name} IS NULL"]
        return " OR ".join(parts) or "FALSE"

    def proved(self, facts: Facts) -> bool:
        """Whether the facts exclude a row that breaks the bound."""
        if not self.nulls and facts.nulls[self.column]:
            return False
        low, high = facts.low[self.column], facts.high[self.column]
        if (self.low is None and self.high is None) or facts.nulls[self.column] == facts.rows:
            return True
        if low is None or high is None or low != low or high != high:  # NaN sorts above all numbers but stands in no bound
            return False
        floats_may_hide_nan = isinstance(high, float) and self.high is not None
        return not floats_may_hide_nan and (self.low is None or low >= self.low) and (self.high is None or high <= self.high)


def judge_bounds(spark: SparkSession, path: str, bounds: Sequence[Bound]) -> DataFrame:
    """column_name, low, high, proved, violations for each bound.

    Bounds that the footers prove take no scan. Of the others, those that row-group statistics can decide share one,
    whose filter lets whole row groups out; upper bounds of floating columns, where NaN may hide, share another. NaN
    is above every bound.
    """
    facts = column_facts(spark, path, sorted({b.column for b in bounds}))
    floating = {f.name for f in spark.read.parquet(path).schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    open_ones = [i for i, b in enumerate(bounds) if not b.proved(facts)]
    hidden = [i for i in open_ones if bounds[i].column in floating and bounds[i].high is not None]
    counted: dict[int, int] = {}
    for own in ([i for i in open_ones if i not in hidden], hidden):
        if own:
            counted.update(zip(own, unproved(spark, path, [bounds[i] for i in own]).first(), strict=True))
    rows = [(b.column, None if b.low is None else float(b.low), None if b.high is None else float(b.high), i not in counted,
             counted.get(i, 0)) for i, b in enumerate(bounds)]
    return spark.createDataFrame(rows, "column_name string, low double, high double, proved boolean, violations long")


def unproved(spark: SparkSession, path: str, bounds: Sequence[Bound]) -> DataFrame:
    """One row b0, b1, …: the rows that break each bound, from the row groups that may hold one."""
    rows = spark.read.parquet(path)
    kinds = {f.name: isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in rows.schema.fields}
    texts = [b.broken(kinds[b.column]) for b in bounds]
    return rows.where(" OR ".join(f"({t})" for t in texts)).agg(
        *[F.count_if(F.coalesce(F.expr(t), F.lit(False))).alias(f"b{i}") for i, t in enumerate(texts)])


def facts_table(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table_name, column_name, row_count, null_count, low, high: bounds of numbers and flags as doubles, dates as days."""
    out = []
    for table, path in paths.items():
        facts = column_facts(spark, path)
        out += [(table, c, facts.rows, n, _number(facts.low[c]), _number(facts.high[c])) for c, n in facts.nulls.items()]
    return spark.createDataFrame(out, "table_name string, column_name string, row_count long, null_count long, low double, high double")


def _number(value: object) -> float | None:
    if value is None:
        return None
    return float(value.toordinal() - 719163) if hasattr(value, "toordinal") else float(value) + 0.0
