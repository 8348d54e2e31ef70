"""Keys that hold too many rows for one task, and operators that split them.

Detection is by sample and only steers the plan: a missed hot key costs time, never rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than this many rows ...
HOT_MIN_ROWS = 2_000_000
#: ... and more than 1/HOT_SHARE of the table, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 50_000
#: Rows expected in the sample for a key that is just hot.
SAMPLE_PER_KEY = 200
#: Number of pieces a hot key is split into, at least ...
PIECES = 64
#: ... and rows that a piece of a larger key has.
ROWS_PER_PIECE = 500_000
#: Sampled rows per piece when a key's order is cut.
SAMPLE_PER_PIECE = 16
#: Range of the row hash that samples.
_SAMPLE_RANGE = 1 << 30


class HotKeys(list):
    """Hot values of a key, with about how many rows each holds (``rows``)."""

    def __init__(self, rows: Mapping = ()) -> None:
        self.rows = dict(rows)
        super().__init__(self.rows)


def _sample_fraction(floor: int) -> float:
    return min(1.0, SAMPLE_PER_KEY / floor)


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_MIN_ROWS, total: int | None = None) -> HotKeys:
    """Values of ``key`` (null included) that hold more than the allowed rows.

    The row count comes from file footers.  Only tables larger than ``min_rows`` are
    sampled; the sample is about ``HOT_SHARE * SAMPLE_PER_KEY`` keys wide at most and the
    list is shorter than ``2 * HOT_SHARE``.
    """
    total = df.count() if total is None else total
    if total <= min_rows:
        return HotKeys()
    floor = max(min_rows, total // HOT_SHARE, 1)
    fraction = _sample_fraction(floor)
    seen = df.select(key) if fraction >= 1.0 else df.select(key).sample(fraction, seed=11)
    frequent = seen.groupBy(key).count().filter(F.col("count") > 0.75 * floor * fraction)
    return HotKeys({row[0]: int(row[1] / fraction) for row in frequent.select(key, "count").collect()})


def _by_pieces(hot: Sequence, pieces: int) -> dict[int, list]:
    """The hot values by the number of pieces they need, a power of two times ``pieces``."""
    groups = defaultdict(list)
    for value in hot:
        many = pieces
        while many * ROWS_PER_PIECE < getattr(hot, "rows", {}).get(value, 0):
            many *= 2
        groups[many].append(value)
    return groups


def _piece_count(column: Column, hot: Sequence, pieces: int) -> Column:
    """Pieces of the row's key: 1 unless it is hot."""
    out = F.lit(1)
    for many, values in _by_pieces(hot, pieces).items():
        out = F.when(is_hot(column, values), F.lit(many)).otherwise(out)
    return out


def is_hot(column: Column, hot: Sequence) -> Column:
    """True where the value is one of the hot keys; never null."""
    values = [v for v in hot if v is not None]
    found = F.coalesce(column.isin(values), F.lit(False)) if values else F.lit(False)
    return found | column.isNull() if any(v is None for v in hot) else found


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner",
              hot: Sequence = (), pieces: int = PIECES) -> DataFrame:
    """Equi-join whose left side may have hot values in the first key.

    Left rows of a hot key are spread over pieces, more for larger keys, by their content
    and the input partition they come from, so that neither exact copies nor an input that
    is already partitioned by the key stay together; right rows of a hot key are repeated
    once per piece.  The right side must be small per key (a dimension or an aggregate).
    """
    keys = [on] if isinstance(on, str) else list(on)
    if not hot:
        return left.join(right, keys, how)
    lead = F.col(keys[0])
    many = _piece_count(lead, hot, pieces)
    spread = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in left.columns])
    left = left.withColumn("_piece", F.pmod(spread, many).cast("int"))
    right = right.withColumn("_piece", F.explode(F.sequence(F.lit(0), many - 1)))
    return left.join(right, [*keys, "_piece"], how).drop("_piece")


def unfold(df: DataFrame, count: str = "_n") -> DataFrame:
    """Every row as often as its ``count`` says, without that column.

    Two steps keep the arrays behind it at the square root of the largest count.
    """
    step = F.ceil(F.sqrt(F.col(count))).cast("long")
    firsts = F.sequence(F.lit(0).cast("long"), F.col(count) - 1, step)
    blocks = df.filter(F.col(count) > 0).withColumn("_first", F.explode(firsts))
    rest = F.least(step, F.col(count) - F.col("_first"))
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), rest))).drop(
        "_first", "_copy", count)


def _split_points(distinct: DataFrame, key: str, order: Sequence[str], hot: Sequence, pieces: int) -> DataFrame:
    """Per hot key, values of the order columns at which to cut its distinct rows.

    Each key is sampled by a hash of its rows, about SAMPLE_PER_PIECE for each of its own
    pieces, so no key goes without cuts and a task that runs again finds the same ones.
    """
    rows = distinct.filter(is_hot(F.col(key), hot)).select(key, *order)
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    many = F.greatest(F.lit(pieces), F.ceil(F.col("_rows") / ROWS_PER_PIECE))
    sizes = sizes.withColumns({"_many": many, "_upto": many * (SAMPLE_PER_PIECE * _SAMPLE_RANGE) / F.col("_rows")})
    # One row per hot key.
    sampled = rows.join(F.broadcast(sizes), F.col(key).eqNullSafe(F.col("_key"))).filter(
        F.pmod(F.xxhash64(*order), F.lit(_SAMPLE_RANGE)) < F.col("_upto"))
    position = F.struct(*[F.col(c).alias(c) for c in order])
    found = sampled.groupBy(key).agg(F.sort_array(F.collect_set(position)).alias("_all"), F.first("_many").alias("_many"))
    step = F.greatest(F.lit(1), F.floor(F.size("_all") / F.col("_many"))).cast("int")
    return found.withColumn("_step", step).select(
        key, F.filter("_all", lambda c, i: (i > 0) & (i % F.col("_step") == 0)).alias("_cuts"))


def with_previous(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str],
                  hot: Sequence = (), pieces: int = PIECES, also: Mapping[str, str] | None = None) -> DataFrame:
    """Every row with the ``values`` of the row before it under the same key.

    Adds ``prev_<column>`` columns, ``has_prev`` and ``_n``, the number of equal rows that a
    row stands for: with or without hot keys, count by summing ``_n`` and list rows by
    ``unfold``.  ``order`` is completed with ``values`` so that ties are settled.
    ``also`` maps a prefix to a condition and adds the values of the last row before that
    meets it, from the same shuffle and sort.

    Without hot keys this is one window over ``key``.  With hot keys, their rows are cut
    at sampled points of the order; each piece gets its own window and looks to the pieces
    before it for what it cannot find inside.  Exact copies are folded first and unfolded
    after, a copy's predecessor being its twin.
    """
    also = dict(also or {})
    order = list(dict.fromkeys([*order, *values]))
    row = F.struct(*[F.col(c).alias(c) for c in values])
    lookups = {"prev_": None, **also}
    plain = df.columns

    def found(prefix: str) -> str:
        return f"_found_{prefix}"

    def meets(condition: str | None, value: Column) -> Column:
        return value if condition is None else F.when(F.expr(condition), value)

    def look(window) -> dict[str, Column]:
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        return {found(p): F.lag(row).over(window) if c is None
                else F.last(meets(c, row), ignorenulls=True).over(before) for p, c in lookups.items()}

    def spread(frame: DataFrame) -> DataFrame:
        return frame.select(
            *plain, "_n", F.col(found("prev_")).isNotNull().alias("has_prev"),
            *[F.col(found(p))[c].alias(p + c) for p in lookups for c in values])

    if not hot:
        # Column by column, so that values nobody asks for are pruned before the shuffle.
        # A wrapped value tells "the row holds null" from "there is no such row".
        window = Window.partitionBy(key).orderBy(*order)
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        adds = {"_n": F.lit(1).cast("long"), "has_prev": F.lag(F.lit(True)).over(window).isNotNull()}
        adds.update({f"prev_{c}": F.lag(c).over(window) for c in values})
        adds.update({p + c: F.last(F.when(F.expr(condition), F.struct(F.col(c).alias("v"))), ignorenulls=True)
                     .over(before)["v"] for p, condition in also.items() for c in values})
        return df.withColumns(adds)

    folded = df.groupBy(*plain).agg(F.count(F.lit(1)).alias("_n"))
    # At most a cut per piece of a hot key: fewer than there are keys to be split times
    # PIECES, plus a cut for every ROWS_PER_PIECE rows.
    cuts = F.broadcast(_split_points(df, key, order, hot, pieces).withColumnRenamed(key, "_cut_key"))
    position = F.struct(*[F.col(c).alias(c) for c in order])
    cut = (folded.join(cuts, F.col(key).eqNullSafe(F.col("_cut_key")), "left").drop("_cut_key")
           .withColumn("_cut", F.coalesce(
               F.size(F.filter("_cuts", lambda c: c <= position)), F.lit(0))))
    inside = cut.withColumns(look(Window.partitionBy(key, "_cut").orderBy(*order)))
    ends = cut.filter(F.col("_cuts").isNotNull()).groupBy(key, "_cut").agg(*[
        F.max_by(row, meets(c, position)).alias(f"_end_{p}") for p, c in lookups.items()])
    earlier = Window.partitionBy(key).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        F.col(key).alias("_carry_key"), F.col("_cut").alias("_carry_cut"),
        *[F.last(f"_end_{p}", ignorenulls=True).over(earlier).alias(f"_carry_{p}") for p in lookups])
    # One row per piece of a hot key.
    joined = inside.join(
        F.broadcast(carry),
        F.col(key).eqNullSafe(F.col("_carry_key")) & (F.col("_cut") == F.col("_carry_cut")), "left",
    ).withColumns({found(p): F.coalesce(found(p), f"_carry_{p}") for p in lookups})
    # The first copy of a row looks back; the others see their twin.
    twin = {p: F.coalesce(meets(c, row), F.col(found(p))) for p, c in lookups.items()}
    copies = F.array(
        F.struct(F.lit(1).cast("long").alias("n"), *[F.col(found(p)).alias(p) for p in lookups]),
        F.struct((F.col("_n") - 1).alias("n"), *[twin[p].alias(p) for p in lookups]))
    unfolded = joined.withColumn("_copy", F.explode(copies)).filter(F.col("_copy.n") > 0)
    return spread(unfolded.withColumns({
        "_n": F.col("_copy.n"), **{found(p): F.col("_copy")[p] for p in lookups}}))
