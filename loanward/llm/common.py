"""Shared-folder tables, row batches and small column helpers of the training-data operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local folders for sessions without spark.checkpoint.dir, which only local ones may lack.
_OWN: dict[str, str] = {}


#: Applications whose executors have been sent this package.
_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Let Spark bring the package to the executors, which need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="loanward-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one on a single machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="loanward-"))


class Scratch:
    """Tables written to the shared folder to cut lineage; lost executors don't touch them."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        """Write ``frame`` and return it as read back."""
        path = f"{self.root}/{name}"
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def column_or_null(frame: DataFrame, name: str, kind: str) -> Column:
    """The column cast to ``kind``, or nulls of that type if it is missing."""
    return F.col(f"`{name}`").cast(kind) if name in frame.columns else F.lit(None).cast(kind)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices whose ``column`` holds about ``limit`` bytes; a longer value stands alone."""
    for batch in batches:
        values = batch.column(column)
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(values).fill_null(0).to_pylist()
        start = total = 0
        for row, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        yield batch.slice(start)


def fresh_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name, in any case."""
    taken = {name.lower() for name in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
