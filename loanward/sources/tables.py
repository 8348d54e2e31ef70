"""The set of tables that a run works on."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanward.operators.skew import HOT_MIN_ROWS, hot_keys, is_hot
from loanward.sources.schemas import MODEL, load_declared

#: The eight tables of the lending data model.
LENDING_TABLES = (
    "applications", "loan_tape", "payments", "credit_reports", "credit_tradelines",
    "fraud_verification", "bank_transactions", "reference_codes",
)

#: Older names of columns, tried when the current name is absent.
COLUMN_ALIASES = {
    "loan_tape": {
        "origination_date": "funding_date",
        "original_interest_rate": "interest_rate",
        "original_term_months": "original_loan_term",
        "original_installment_amount": "scheduled_payment_amount",
    },
    # Either name occurs alone; rules read both.
    "credit_reports": {
        "inquiries_6mo_count": "inquiries_last_6mo_count",
        "inquiries_last_6mo_count": "inquiries_6mo_count",
    },
}

#: Rows of a key on each side from which a join's pairs are counted instead of made.
CROWD_ROWS = 10_000

#: Rows of all tables together for each shuffle partition.
ROWS_PER_PARTITION = 500_000

#: Shuffled bytes of a partition up to which a join hashes it instead of sorting both sides; Spark asks for at least
#: the advised size of a partition.
HASHED_JOIN_BYTES = 64 << 20

DEFAULT_AS_OF = dt.date(2023, 12, 31)


def size_shuffles(frames: Iterable[DataFrame], rows_per_partition: int = ROWS_PER_PARTITION) -> int:
    """Give the session at least one shuffle partition for so many rows of the frames, and return how many it has.

    A fixed number would let the rows of each task, its memory and what it spills grow with the tables. The session's
    own number is only raised; adaptive execution still joins partitions of small shuffles. Plain Parquet tables are
    counted from their footers, in one job.
    """
    counts = reduce(DataFrame.unionAll, [df.agg(F.count(F.lit(1)).alias("rows")) for df in frames])
    conf, needed = counts.sparkSession.conf, -(-sum(r.rows for r in counts.collect()) // rows_per_partition)
    known = int(conf.get("spark.sql.shuffle.partitions"))
    if needed <= known:
        return known
    conf.set("spark.sql.shuffle.partitions", needed)
    # Joined partitions are otherwise as large as the advised size in compressed bytes, whatever rows these hold.
    conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum", needed)
    # A scan's task folds what it reads before the shuffle; keys that hardly repeat would fill and spill its memory.
    conf.set("spark.sql.files.minPartitionNum", needed)
    # Partitions of so many rows fit a task's memory, so that joins need not sort them.
    conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", HASHED_JOIN_BYTES)
    return needed


class Tables(Mapping[str, DataFrame]):
    """Named lazy DataFrames plus what the plans need to know about them.

    ``hot(table, key)`` answers which key values are frequent enough to overload one
    task.  The answer steers the plan only; results do not depend on it.  ``declared`` holds
    the columns each table should have: those given, else those of the lending model; ``bucketed``
    the key that a table is laid out by, all such tables having the same number of buckets.
    """

    def __init__(self, frames: Mapping[str, DataFrame], as_of: dt.date = DEFAULT_AS_OF,
                 hot_min_rows: int = HOT_MIN_ROWS, declared: Mapping[str, Sequence[str]] | None = None,
                 bucketed: Mapping[str, str] | None = None):
        self._frames = dict(frames)
        self.as_of = as_of
        self.hot_min_rows = hot_min_rows
        self.declared = {**MODEL, **(declared or {})}
        self.bucketed = dict(bucketed or {})
        self._hot: dict[tuple[str, str], list] = {}
        self._rows: dict[str, int] = {}
        self._crowded: dict[tuple[str, str, str], list] = {}

    def __getitem__(self, name: str) -> DataFrame:
        return self._frames[name]

    def __iter__(self):
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    @property
    def spark(self) -> SparkSession:
        return next(iter(self._frames.values())).sparkSession

    def columns(self, name: str) -> list[str]:
        return self._frames[name].columns if name in self._frames else []

    def project(self, name: str, columns: Iterable[str]) -> DataFrame:
        """The listed columns of a table that exist there."""
        present = self.columns(name)
        return self._frames[name].select([c for c in dict.fromkeys(columns) if c in present])

    def row_count(self, name: str) -> int:
        """Rows of one table, counted once; plain Parquet tables read footers only."""
        if name not in self._rows:
            self._rows[name] = self._frames[name].count()
        return self._rows[name]

    def hot(self, name: str, key: str) -> list:
        if (name, key) not in self._hot:
            self._hot[name, key] = hot_keys(self._frames[name], key, self.hot_min_rows, self.row_count(name))
        return self._hot[name, key]

    def crowded(self, left: str, right: str, key: str) -> list:
        """Key values that both tables repeat often, so that a join would pair their rows; null, which joins nothing, is none.

        A key is looked for from CROWD_ROWS rows (or 1/50,000 of the table) on, on the left side only where the right
        one has such keys.
        """
        if (left, right, key) not in self._crowded:
            few = min(CROWD_ROWS, self.hot_min_rows)
            sides = []
            for name in (right, left):
                if not sides or sides[-1]:
                    sides.append(hot_keys(self._frames[name], key, few, self.row_count(name)))
            self._crowded[left, right, key] = [k for k in sides[0] if k is not None and k in sides[-1]]
        return self._crowded[left, right, key]

    def without(self, name: str, key: str, values: Sequence) -> Tables:
        """The tables without the rows of one that hold the values; what is known of keys stays."""
        out = self.replace(**{name: self._frames[name].filter(~is_hot(F.col(key), values))})
        out._hot, out._rows, out._crowded = self._hot, self._rows, self._crowded
        return out

    def replace(self, **frames: DataFrame) -> Tables:
        return Tables({**self._frames, **frames}, self.as_of, self.hot_min_rows, self.declared)


def typed_nulls(df: DataFrame, declared: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """Give columns of null type their declared type, string when none is declared."""
    declared = declared or {}
    casts = {
        f.name: F.col(f.name).cast(declared.get(f.name, T.StringType()))
        for f in df.schema.fields if isinstance(f.dataType, T.NullType)
    }
    return df.withColumns(casts) if casts else df


def add_aliases(df: DataFrame, name: str) -> DataFrame:
    """Add the current column name where only an older or newer one exists."""
    present = set(df.columns)
    adds = {}
    for current, older in COLUMN_ALIASES.get(name, {}).items():
        if current not in present and older in present:
            adds[current] = F.col(older)
    return df.withColumns(adds) if adds else df


def load_tables(spark: SparkSession, directory: str, names: Iterable[str] = LENDING_TABLES,
                as_of: dt.date = DEFAULT_AS_OF, schemas: str | None = None, **options) -> Tables:
    """Read ``{directory}/{name}.parquet`` for every name; absent files are left out.

    ``schemas`` is a folder of declared schemas (``{name}.csv``) that DQ-003 compares with.
    """
    frames = {}
    for name in names:
        try:
            df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        frames[name] = add_aliases(typed_nulls(df), name)
    if frames:
        size_shuffles(frames.values())
    if schemas:
        options["declared"] = {n: [c.name for c in load_declared(spark, f"{schemas.rstrip('/')}/{n}.csv")] for n in frames}
    return Tables(frames, as_of, **options)


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: number of rows and of columns."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.lit(len(df.columns)).cast("long").alias("column_count"))
        out = row if out is None else out.unionAll(row)
    if out is None:
        raise ValueError("no tables to describe")
    return out


def write_table(df: DataFrame, directory: str, name: str, partition_by: Iterable[str] = (),
                mode: str = "overwrite") -> str:
    """Write ``{directory}/{name}.parquet``, optionally split by partition columns.

    Rows of one partition value are clustered on several tasks (by value and a slice of
    the input), so that one large month neither lands in one task nor makes a file per task.
    """
    path = f"{directory.rstrip('/')}/{name}.parquet"
    keys = list(partition_by)
    if keys:
        df = df.hint("rebalance", *[F.col(k) for k in keys])
    df.write.mode(mode).partitionBy(*keys).parquet(path)
    return path


def write_month_partitioned(df: DataFrame, directory: str, name: str, date_column: str) -> str:
    """Write a panel or event table split by the month of ``date_column``."""
    month = df.withColumn("month", F.date_format(date_column, "yyyy-MM"))
    return write_table(month, directory, name, ["month"])


def sample_tables(tables: Tables, fraction: float, seed: int = 7, key: str = "application_id") -> Tables:
    """A sample that keeps families together.

    Tables with the key are sampled by the md5 of its value (twelve hex digits, so fractions
    down to 1e-14 work), so parents and children agree without a join and other engines can
    repeat the choice.  Payments and tradelines follow their loan or report; those without a parent in
    the full tables stay in, so that orphan rules keep their meaning.
    """
    digits = 12
    threshold = format(min(round(fraction * 16**digits), 16**digits - 1), f"0{digits}x")
    frames = {}
    for name, df in tables.items():
        if key in df.columns:
            mark = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, digits)
            frames[name] = df.filter(mark < threshold) if fraction < 1 else df
        else:
            frames[name] = df
    loans, payments = frames.get("loan_tape"), frames.get("payments")
    if loans is not None and payments is not None and key not in payments.columns:
        dropped = tables["loan_tape"].select("loan_id").distinct().join(
            loans.select("loan_id").distinct(), "loan_id", "left_anti")
        frames["payments"] = payments.join(dropped, "loan_id", "left_anti")
    reports, lines = frames.get("credit_reports"), frames.get("credit_tradelines")
    if reports is not None and lines is not None and key not in lines.columns:
        dropped = tables["credit_reports"].select("credit_report_id").distinct().join(
            reports.select("credit_report_id").distinct(), "credit_report_id", "left_anti")
        frames["credit_tradelines"] = lines.join(dropped, "credit_report_id", "left_anti")
    return Tables(frames, tables.as_of, tables.hot_min_rows, tables.declared)
