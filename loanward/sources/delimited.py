"""CSV tables read by a declared schema, with what did not fit it.

All fields are read as text and cast by a cast that gives null instead of failing. What a column lost that way is
counted in one scan; a line with the wrong number of fields is kept, marked, and left out of the columns' counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanward.sources.schemas import DeclaredColumn

#: The column that holds a malformed line.
MALFORMED = "_malformed"
_LENGTH = re.compile(r"CHAR\w*\s*\(\s*(\d+)\s*\)", re.IGNORECASE)


@dataclass(frozen=True)
class Delimited:
    """``rows``: the declared columns, typed, in declared order, and ``_malformed``, the text of a line with a wrong
    number of fields, else null. Columns that the file lacks are null; those that it has beyond the declared are left out."""

    rows: DataFrame
    text: DataFrame
    declared: Sequence[DeclaredColumn]
    in_file: Sequence[str]

    def faults(self) -> DataFrame:
        """column_name, declared_type, presence, filled, bad, too_long, in one scan.

        ``filled`` fields hold text, of which ``bad`` ones could not be cast and ``too_long`` ones exceed a declared
        length. Presence is PRESENT, MISSING or EXTRA; the row ``*`` has all lines as filled and malformed ones as bad.
        """
        sound = F.col(MALFORMED).isNull()
        kinds = {c.name: c for c in self.declared}
        places = {name: i for i, name in enumerate(self.in_file)}
        sums = [F.count(F.lit(1)).alias("n"), F.count(MALFORMED).alias("m")]
        cells = [_cell("*", None, "PRESENT", F.col("n"), F.col("m"), F.lit(0))]
        for name in [*kinds, *(c for c in self.in_file if c not in kinds)]:
            kind = kinds.get(name)
            if name not in places:
                cells.append(_cell(name, kind.sql_type, "MISSING", F.lit(0), F.lit(0), F.lit(0)))
                continue
            i = places[name]
            field = F.col(f"f{i}")
            sums.append(F.count_if(sound & field.isNotNull()).alias(f"a{i}"))
            bad = long = F.lit(0)
            if kind:
                sums.append(F.count_if(sound & field.isNotNull() & _typed(field, kind).isNull()).alias(f"b{i}"))
                bad, limit = F.col(f"b{i}"), _LENGTH.search(kind.sql_type)
                if limit:
                    sums.append(F.count_if(sound & (F.length(field) > int(limit.group(1)))).alias(f"l{i}"))
                    long = F.col(f"l{i}")
            cells.append(_cell(name, kind and kind.sql_type, "PRESENT" if kind else "EXTRA", F.col(f"a{i}"), bad, long))
        return self.text.agg(*sums).select(F.inline(F.array(*cells)))


def _cell(name: str, declared: str | None, presence: str, filled: Column, bad: Column, too_long: Column) -> Column:
    return F.struct(F.lit(name).alias("column_name"), F.lit(declared).cast("string").alias("declared_type"),
                    F.lit(presence).alias("presence"), filled.cast("long").alias("filled"), bad.cast("long").alias("bad"),
                    too_long.cast("long").alias("too_long"))


def _typed(field: Column, kind: DeclaredColumn) -> Column:
    text = field if isinstance(kind.type, T.StringType) else F.trim(field)
    return text.try_cast(kind.type)


def read_declared_csv(spark: SparkSession, path: str, declared: Sequence[DeclaredColumn], in_file: Sequence[str] | None = None,
                      **options) -> Delimited:
    """Read CSV files as declared; ``options`` go to the reader (``sep``, ``quote``, ``multiLine``, …).

    Files have a header, which says where a declared column stands, unless ``in_file`` lists their columns. An empty
    field is null, and a quote inside quotes is doubled. A name that occurs twice in a file is refused, as is a table without a declared column.
    """
    if not declared:
        raise ValueError("no column is declared")
    options = {"escape": '"', **options}
    header = in_file is None
    if header:
        first = spark.read.options(header=False, **options).csv(path).first()  # one line
        in_file = [(c or "").strip() for c in first] if first else []
    repeated = sorted({c for c in in_file if list(in_file).count(c) > 1})
    if repeated:
        raise ValueError(f"columns that occur twice in {path}: {', '.join(repeated)}")
    fields = [T.StructField(f"f{i}", T.StringType()) for i in range(max(1, len(in_file)))]
    schema = T.StructType([*fields, T.StructField(MALFORMED, T.StringType())])
    # Without pruning the reader sees how many fields a line has, whatever columns are asked for.
    text = spark.read.schema(schema).options(
        header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED, columnPruning=False, enforceSchema=True,
        **options).csv(path)
    # Spark refuses a scan that asks for the malformed text alone; no text is smaller than the empty one.
    text = text.withColumn(MALFORMED, F.coalesce(MALFORMED, F.when(F.col("f0") < "", F.col("f0"))))
    places = {name: i for i, name in enumerate(in_file)}
    rows = text.select(*[(_typed(F.col(f"f{places[c.name]}"), c) if c.name in places else F.lit(None).cast(c.type)).alias(c.name)
                         for c in declared], MALFORMED)
    return Delimited(rows, text, declared, in_file)
