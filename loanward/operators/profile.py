"""Profiles: null rates, histograms, shares, rates, cohorts, dispersion, schemas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanward.functions.sqltext import literal, over


def rate(df: DataFrame, condition: str, name: str = "pct") -> DataFrame:
    """One row: matching rows, all rows and their percentage (null for no rows)."""
    hits = F.count_if(F.expr(condition))
    total = F.count(F.lit(1))
    return df.agg(hits.alias("matching"), total.alias("total")).withColumn(
        name, F.try_divide(F.col("matching") * 100.0, F.col("total")))


def shares(df: DataFrame, column: str, name: str = "pct") -> DataFrame:
    """Rows and percentage per value; the row count of the table is a scalar subquery."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    return over({"counts": counts, "rows": df}, f"""
        SELECT *, try_divide(row_count * 100D, (SELECT count(*) FROM {{rows}})) AS `{name}` FROM {{counts}}""")


def bucketed(column: str, width: float) -> Column:
    """Lower edge of the fixed-width bucket a value falls into."""
    return F.floor(F.col(column) / F.lit(width)) * F.lit(width)


def histogram(df: DataFrame, bucket: Column, name: str = "bucket", where: str | None = None) -> DataFrame:
    """Rows per bucket."""
    rows = df.filter(where) if where else df
    return rows.groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("row_count"))


def value_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows per value for several low-cardinality columns, in one scan.

    Values are folded per row into (column, value) pairs and counted with a map-side
    combine.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    return (df.select(F.inline(pairs)).groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("row_count")))


def group_rates(df: DataFrame, by: Sequence[Column | str], conditions: Mapping[str, str],
                where: str | None = None) -> DataFrame:
    """Per group: row count and, for each named condition, count and percentage."""
    rows = df.filter(where) if where else df
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.expr(c)).alias(f"{n}_count") for n, c in conditions.items()])
    return out.withColumns({
        f"{n}_pct": F.try_divide(F.col(f"{n}_count") * 100.0, F.col("row_count")) for n in conditions})


def bucket_means(df: DataFrame, bucket: Column, value: str, name: str = "bucket") -> DataFrame:
    """Mean of ``value`` per bucket."""
    return df.groupBy(bucket.alias(name)).agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(value).alias(f"avg_{value}"))


def labelled(column: str, cuts: Sequence[tuple[float | None, str]]) -> Column:
    """Label by upper cut points: the first ``value <= cut`` wins, ``None`` is the rest."""
    out = None
    for cut, label in cuts:
        if cut is None:
            return F.lit(label) if out is None else out.otherwise(F.lit(label))
        test = F.col(column) <= F.lit(cut)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def dispersion(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample standard deviation, minimum and maximum."""
    return df.agg(F.count(column).alias("value_count"), F.avg(column).alias("mean"),
                  F.stddev_samp(column).alias("stddev"), F.min(column).alias("minimum"),
                  F.max(column).alias("maximum"))


def correlation(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: Pearson correlation (null where a column is constant) and the number of pairs."""
    both = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    spread = F.stddev_pop(left) * F.stddev_pop(right)
    return both.agg(F.try_divide(F.covar_pop(left, right), spread).alias("correlation"),
                    F.count(F.lit(1)).alias("pairs"))


#: Quantiles around the middle at which values are cut for the exact median.
MEDIAN_CUTS = tuple(round(0.495 + 0.0005 * i, 4) for i in range(21))


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group, without gathering a group in one task.

    Approximate quantiles close to the middle cut each group into slices; exact counts per
    slice tell which one holds the middle, and only its values are ranked (about one row
    in two thousand).  Where the quantiles are off, more is ranked; the result is the same.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, value)
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, list(MEDIAN_CUTS), 20000).alias("_cuts"),
                                 F.count(F.lit(1)).alias("_t"))
    freq = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    sliced = _null_safe(freq, cuts, by).withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")
    # At most one row per group and slice.
    per_slice = sliced.groupBy(*by, "_slice", "_t").agg(F.sum("_c").alias("_sc"))
    upto = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = per_slice.withColumn("_end", F.sum("_sc").over(upto))
    # Ranks (from 1) of the one or two middle values.
    low, high = F.floor((F.col("_t") + 1) / 2), F.floor(F.col("_t") / 2) + 1
    middle = placed.filter((F.col("_end") >= low) & (F.col("_end") - F.col("_sc") < high)).select(
        *by, "_slice", (F.col("_end") - F.col("_sc")).alias("_start"))
    inside = _null_safe(sliced, middle, [*by, "_slice"])
    rank = Window.partitionBy(*by, "_slice").orderBy(value)
    ranked = inside.withColumn("_to", F.col("_start") + F.sum("_c").over(rank.rowsBetween(
        Window.unboundedPreceding, Window.currentRow))).withColumn("_from", F.col("_to") - F.col("_c"))
    hit_low = (F.col("_from") < low) & (F.col("_to") >= low)
    hit_high = (F.col("_from") < high) & (F.col("_to") >= high)
    return ranked.groupBy(*by).agg(
        ((F.max(F.when(hit_low, F.col(value))) + F.max(F.when(hit_high, F.col(value)))) / 2.0).alias(name))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys match."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True))  # one row on the right
    other = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = test if condition is None else condition & test
    return left.join(other, condition).drop(*[f"_r_{k}" for k in keys])


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with its nulls; all columns come from one aggregate."""
    names = list(columns) if columns is not None else df.columns
    counted = df.agg(F.count(F.lit(1)).alias("total"),
                     *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"),
                              F.col("total").alias("row_count")) for i, c in enumerate(names)])
    return counted.select(F.inline(rows)).withColumn(
        "null_pct", F.try_divide(F.col("null_count") * 100.0, F.col("row_count")))


def declared_profile(df: DataFrame, declared: Iterable[str]) -> DataFrame:
    """One row per declared column: whether the frame has it and how many values it holds."""
    names = list(declared)
    present = [c for c in names if c in df.columns]
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(present)],
                    F.count(F.lit(1)).alias("_rows"))
    at = {c: i for i, c in enumerate(present)}
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(c in at).alias("present"),
                      (F.col(f"n{at[c]}") if c in at else F.lit(0).cast("long")).alias("filled")) for c in names]
    return filled.select(F.inline(F.array(*cells)))


def schema_gaps(df: DataFrame, declared: Sequence[str], table: str) -> DataFrame:
    """Declared columns that are absent and present columns that are not declared.

    Reads the schema only.
    """
    present = list(df.columns)
    rows = [(table, c, "MISSING") for c in declared if c not in present]
    rows += [(table, c, "EXTRA") for c in present if c not in declared]
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows) or "('', '', '')"
    return df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(table_name, column_name, gap) WHERE gap <> ''")
