"""Tables laid out by a key, so that work on that key moves no rows.

A table is written in buckets of its key. Windows, ledgers and joins by the key then read bucket after bucket without
an exchange. A key with too many rows would fill one bucket, so rows of such keys stand in a table of their own,
without buckets, and go through the operators that split them; results of both parts are put together.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanward.operators.skew import is_hot
from loanward.plans.rule import Relation
from loanward.sources.tables import Tables, write_table

#: Rows of the largest table for each bucket, which one task sorts, writes and reads.
ROWS_PER_BUCKET = 500_000

#: Folders of local sessions that have no spark.checkpoint.dir.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local session without it has its own."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="loanward-"))
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Layout:
    """Tables by key in buckets, all with the same number of them, and the rows that stand aside."""

    bucketed: Tables
    aside: Tables

    def relation(self, relation: Relation) -> DataFrame:
        """A relation whose rows each belong to one key: that of the buckets and that of the rows aside."""
        return relation.build(self.bucketed).unionByName(relation.build(self.aside))


def bucket_count(tables: Tables, keys: Mapping[str, str], least: int = 8, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets that grow with the largest of the tables, so that what one task reads doesn't."""
    return max(least, *(-(-tables.row_count(name) // rows_per_bucket) for name in keys))


def write_bucketed(tables: Tables, directory: str, keys: Mapping[str, str], buckets: int,
                   order: Mapping[str, Sequence[str]] | None = None) -> None:
    """Write ``{name}_by_{key}`` (buckets) and ``{name}_aside`` below ``directory`` for each table in ``keys``.

    Keys are aside in all tables if they are hot in one, so that rows that meet stay in one part. Each bucket is one
    file, sorted by the key and the columns in ``order``.
    """
    hot = _aside(tables, keys)
    for name, key in keys.items():
        df = tables[name]
        away = is_hot(F.col(key), hot)
        writer = df.filter(~away).repartition(buckets, key).write.format("parquet").mode("overwrite")
        path = f"{directory.rstrip('/')}/{name}_by_{key}"
        label = f"layout_{uuid.uuid4().hex}"
        writer.bucketBy(buckets, key).sortBy(key, *(order or {}).get(name, ())).option("path", path).saveAsTable(label)
        tables.spark.sql(f"DROP TABLE {label}")  # an external table: its files stay
        write_table(df.filter(away), directory, f"{name}_aside")


def _aside(tables: Tables, keys: Mapping[str, str]) -> list:
    """Hot values of the key over all tables; fewer than 100,000 for each table."""
    return list(dict.fromkeys(k for name, key in keys.items() for k in tables.hot(name, key)))


def open_bucketed(spark: SparkSession, directory: str, keys: Mapping[str, str], buckets: int, **options) -> Layout:
    """The tables that ``write_bucketed`` left in ``directory``."""
    frames, aside = {}, {}
    for name, key in keys.items():
        path, label = f"{directory.rstrip('/')}/{name}_by_{key}", f"layout_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE {label} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
        frames[name] = spark.table(label)
        aside[name] = spark.read.parquet(f"{directory.rstrip('/')}/{name}_aside.parquet")
    calm = Tables(frames, **options, bucketed=keys)
    calm._hot = {(name, key): [] for name, key in keys.items()}  # hot rows stand aside
    return Layout(calm, Tables(aside, **options))
