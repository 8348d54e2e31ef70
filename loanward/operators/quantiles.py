"""Exact quantiles: several columns, groups and ranks in the same passes.

Values are folded to distinct ones with counts. An interval, at first a whole group, that holds more distinct values
than one task should sort is cut by approximate quantiles of these values; exact counts of the slices tell which of
them hold an asked rank, and only those are kept for the next pass. When all intervals are small, each is sorted once
and ranks are read off. How many passes there are follows from the data's size (a pass makes an interval at least a
hundred times smaller); the result doesn't depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanward.sources.layout import shared_folder

#: Distinct values that one task sorts.
SORTED_VALUES = 200_000
#: Slices that a pass cuts an interval into, and the accuracy of the cuts.
SLICES, ACCURACY = 200, 10_000
#: Cut intervals whose cuts (SLICES doubles each) are broadcast; more are shuffled, repeated for SPREAD pieces of an interval.
BROADCAST_INTERVALS, SPREAD = 5_000, 64

_INTERVAL = ["_g", "_start"]
#: How many of the sorted cuts a value reaches, in halving steps: a value meets a few cuts instead of all.
_SLICE = (f"aggregate(array({', '.join(str(1 << i) for i in reversed(range((SLICES - 1).bit_length())))}), 0, (reached, step) -> "
          "IF(coalesce(get(_cuts, reached + step - 1) <= v, FALSE), reached + step, reached))")


def exact_quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], probabilities: Sequence[float],
                    interpolate: bool = True, sorted_values: int = SORTED_VALUES) -> DataFrame:
    """``by``, column_name, value_count, probability, quantile: a row for each group, column and probability.

    With ``interpolate`` a quantile between two values is weighted linearly, else it is the smallest value that at
    least the share of values doesn't exceed. Columns are numbers and are read as doubles. Nulls are left out, a column
    of a group without values has no rows; NaN is greater than all numbers; a null group is a group, equal values are
    counted as often as they occur. ``by`` may be empty; names may not start with an underscore.
    """
    if not probabilities or any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    folded = _folded(df, by, columns)
    sizes = folded.groupBy("_g").agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_m"))
    ready = reduce(DataFrame.unionByName, _narrowed(folded, sizes, probabilities, interpolate, sorted_values))
    return _read_off(ready, by, probabilities, interpolate)


def _folded(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct values (_g, v) of every group and column with their rows _c, written once: all passes read them."""
    flat = [f"b{i}" for i in range(len(by))]
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])
    rows = df.select(*[F.col(f"`{b}`").alias(f) for b, f in zip(by, flat, strict=True)], F.inline(cells)).filter("v IS NOT NULL")
    # Plain columns while rows are many; then a struct, which groups and joins nulls as values.
    counted = rows.groupBy(*flat, "c", "v").agg(F.count(F.lit(1)).alias("_c"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1)
    path = f"{shared_folder(df.sparkSession)}/folded"
    counted.select(F.struct(*flat, name.alias("c")).alias("_g"), "v", "_c").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _ranks(total: Column, probabilities: Sequence[float], interpolate: bool) -> list[tuple[Column, Column, Column]]:
    """For each probability the ranks (from 0) of the two values around it and the weight of the upper one."""
    out = []
    for p in probabilities:
        if interpolate:
            at = (total - 1) * F.lit(float(p))
            low = F.floor(at)
            out.append((low, F.ceil(at), at - low))
        else:
            low = F.greatest(F.ceil(total * F.lit(float(p))) - 1, F.lit(0).cast("long"))
            out.append((low, low, F.lit(0.0)))
    return out


def _narrowed(folded: DataFrame, sizes: DataFrame, probabilities: Sequence[float], interpolate: bool,
              sorted_values: int) -> list[DataFrame]:
    """Frames (_g, _start, v, _c, _t) of intervals with at most ``sorted_values`` distinct values that hold every asked rank.

    ``_start`` is the number of the group's rows below the interval, ``_t`` that of all its rows, null where the
    interval is the whole group.
    """
    done = []
    part = folded.withColumns({"_start": F.lit(0).cast("long"), "_t": F.lit(None).cast("long")})
    large = sizes.filter(F.col("_m") > sorted_values).withColumn("_start", F.lit(0).cast("long"))
    while True:
        # One number for the driver, not the intervals.
        n_large = large.count()
        if not n_large:
            return [*done, part]
        ids = large.select(*_INTERVAL)
        done.append(_meet(part, ids, n_large, "left_anti"))
        crowded = _meet(part, ids, n_large, "left_semi").select(*_INTERVAL, "v", "_c")
        evenly = [i / SLICES for i in range(1, SLICES)]
        cuts = crowded.groupBy(*_INTERVAL).agg(F.sort_array(F.percentile_approx("v", evenly, ACCURACY)).alias("_cuts")).join(
            large.select(*_INTERVAL, "_t"), _INTERVAL)
        sliced = _meet(crowded, cuts, n_large, "inner").withColumn("_slice", F.expr(_SLICE))
        counted = sliced.groupBy(*_INTERVAL, "_slice").agg(
            F.sum("_c").alias("_rows"), F.count(F.lit(1)).alias("_m"), F.first("_t").alias("_t"))
        # An interval has at most SLICES rows here.
        before = Window.partitionBy(*_INTERVAL).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_low", F.col("_start") + F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        asked = F.array(*[r.cast("long") for low, high, _ in _ranks(F.col("_t"), probabilities, interpolate) for r in (low, high)])
        held = F.exists(asked, lambda r: (r >= F.col("_low")) & (r < F.col("_low") + F.col("_rows")))
        # The slices go on as intervals; what is kept is written, so that a pass reads only what the one before it left.
        spark, folder = folded.sparkSession, shared_folder(folded.sparkSession)
        placed.filter(held).select(*_INTERVAL, "_slice", "_low", "_t", "_m").write.parquet(f"{folder}/slices")
        kept = spark.read.parquet(f"{folder}/slices")
        wanted = kept.groupBy(*_INTERVAL).agg(F.map_from_entries(F.collect_list(F.struct("_slice", "_low"))).alias("_lows"))
        narrowed = _meet(sliced.select(*_INTERVAL, "v", "_c", "_t", "_slice"), wanted, n_large, "inner").withColumn(
            "_low", F.expr("try_element_at(_lows, _slice)")).filter("_low IS NOT NULL")
        narrowed.select("_g", "v", "_c", F.col("_low").alias("_start"), "_t").write.parquet(f"{folder}/values")
        part = spark.read.parquet(f"{folder}/values")
        large = kept.filter(F.col("_m") > sorted_values).select("_g", F.col("_low").alias("_start"), "_t", "_m")


def _meet(part: DataFrame, intervals: DataFrame, n_intervals: int, how: str) -> DataFrame:
    """Values joined with facts of their intervals; a crowded interval is never one task's."""
    if n_intervals <= BROADCAST_INTERVALS:
        return part.join(F.broadcast(intervals), _INTERVAL, how)
    spread = part.withColumn("_piece", F.pmod(F.xxhash64("v"), F.lit(SPREAD)))
    repeated = intervals.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return spread.join(repeated, [*_INTERVAL, "_piece"], how).drop("_piece")


def _read_off(ready: DataFrame, by: Sequence[str], probabilities: Sequence[float], interpolate: bool) -> DataFrame:
    """Sort each interval once and take the values at the asked ranks."""
    whole = Window.partitionBy(*_INTERVAL)
    upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ready.withColumns({
        "_to": F.col("_start") + F.sum("_c").over(upto), "_all": F.coalesce("_t", F.sum("_c").over(whole))})
    asked = _ranks(F.col("_all"), probabilities, interpolate)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to")), F.col("v")))

    found = ranked.groupBy("_g").agg(
        F.first("_all").alias("_all"), *[at(low).alias(f"l{i}") for i, (low, _, _) in enumerate(asked)],
        *[at(high).alias(f"h{i}") for i, (_, high, _) in enumerate(asked)])
    cells = []
    for i, (p, (_, _, weight)) in enumerate(zip(probabilities, asked, strict=True)):
        low, high = F.col(f"l{i}"), F.col(f"h{i}")
        between = F.when((weight == 0) | (low == high), low).otherwise(low + (high - low) * weight)
        cells.append(F.struct(F.lit(float(p)).alias("probability"), between.alias("quantile")))
    return found.select(*[F.col(f"_g.b{i}").alias(b) for i, b in enumerate(by)], F.col("_g.c").alias("column_name"),
                        F.col("_all").alias("value_count"), F.inline(F.array(*cells)))
