"""Counting pairs of rows that share a key and meet a condition, without making the pairs.

Where a key is frequent on both sides of a join, its pairs grow with the product. What a rule wants of them is their
number, and that follows from order: sort the compared values of both sides and, at each left row, count the right
rows passed so far. Sides are folded first; sorted rows of one key are cut into pieces, which are counted apart and
take over the counts of the pieces before them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanward.functions.sqltext import over

#: Folded rows of a key that one task sorts.
ROWS_PER_PIECE = 500_000
#: Rows looked at for each cut.
SAMPLE_PER_PIECE = 16
_RANGE = 1 << 30


@dataclass(frozen=True)
class Meeting:
    """Pairs whose left row and right row each meet a condition and whose values compare as said.

    Expressions are SQL over the columns of their own side. Without ``left`` all pairs that meet the conditions count;
    a null value meets nothing.
    """

    left_where: str = "TRUE"
    right_where: str = "TRUE"
    left: str | None = None
    op: str = ">="
    right: str | None = None


#: Each comparison as a share of all right rows plus signed counts of right rows up to the left value, with or
#: without those equal to it.
_COUNTS: dict[str, tuple[int, tuple[tuple[int, bool], ...]]] = {
    "<": (1, ((-1, True),)), "<=": (1, ((-1, False),)), ">": (0, ((1, False),)), ">=": (0, ((1, True),)),
    "=": (0, ((1, True), (-1, False))), "<>": (1, ((-1, True), (1, False))),
}
_LOCAL_MICROS = ("unix_date(CAST({0} AS DATE)) * 86400000000L + (hour({0}) * 3600L + minute({0}) * 60L) * 1000000L "
                 "+ CAST(extract(SECOND FROM CAST({0} AS TIMESTAMP_NTZ)) * 1000000L AS BIGINT)")
#: Values of one comparison stand in one of these columns, the others being null.
_CELLS = ("whole", "broken", "name")


def _cell(left: T.DataType, right: T.DataType, op: str) -> tuple[str, str]:
    """The column that holds values of these types, and how an expression gets there."""
    kinds = (left, right)
    if any(isinstance(k, T.TimestampNTZType) for k in kinds) and all(isinstance(k, (T.DateType, T.TimestampNTZType)) for k in kinds):
        return "whole", _LOCAL_MICROS  # no time zone, so no hour that comes twice
    if all(isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)) for k in kinds):
        return "whole", "unix_micros(CAST({} AS TIMESTAMP))"
    if all(isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for k in kinds):
        return "whole", "CAST({} AS BIGINT)"
    if all(isinstance(k, T.NumericType) and not isinstance(k, T.DecimalType) for k in kinds):
        return "broken", "CAST({} AS DOUBLE)"
    if all(isinstance(k, T.StringType) for k in kinds) and op in ("=", "<>"):
        return "name", "unhex(md5({}))"  # of one width, so that cuts are small
    raise ValueError(f"cannot compare {left.simpleString()} {op} {right.simpleString()} by counting")


def _points(left: DataFrame, right: DataFrame, tests: Mapping[str, Sequence[Meeting]]) -> tuple[list[dict], dict[str, list[str]]]:
    """Counts to take (test, share, sign), and for each side the rows it gives to them as SQL structs."""
    sides = {"left": left, "right": right}
    valued = [(s, getattr(m, s)) for own in tests.values() for m in own for s in sides if m.left is not None]
    types = {(s, e): sides[s].selectExpr(e).schema[0].dataType for s, e in dict.fromkeys(valued)}
    counts: list[dict] = []
    cells: dict[str, list[str]] = {"left": [], "right": []}
    for test, own in tests.items():
        for m in own:
            cell, text = ("whole", "{}") if m.left is None else _cell(types["left", m.left], types["right", m.right], m.op)
            share, parts = _COUNTS[m.op]
            for n, (sign, equal) in enumerate(parts):
                for side, where, value in (("left", m.left_where, m.left or "1L"), ("right", m.right_where, m.right or "1L")):
                    # At one value right rows come first if they are to be counted, else last.
                    tie = (side == "left") == equal
                    filled = {c: "CAST(NULL AS {})".format({"whole": "BIGINT", "broken": "DOUBLE", "name": "BINARY"}[c]) for c in _CELLS}
                    filled[cell] = text.format(value)
                    row = f"struct({len(counts)} AS point, " + ", ".join(f"{e} AS {c}" for c, e in filled.items()) + f", {int(tie)} AS tie)"
                    cells[side].append(f"CASE WHEN ({where}) AND {filled[cell]} IS NOT NULL THEN {row} END")
                counts.append({"test": test, "share": share if n == 0 else 0, "sign": sign})
    return counts, cells


def match_counts(left: DataFrame, right: DataFrame, key: str, tests: Mapping[str, Sequence[Meeting]],
                 identity: Sequence[str] = (), rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """test, the identity columns of the left side, violations: how many pairs meet each test; rows without pairs are left out.

    Both sides may hold any number of rows of a key. Meetings of one test must exclude each other, their counts add
    up. Rows with a null key meet nothing. Work grows with the rows of both sides, by the number of comparisons.
    """
    counts, cells = _points(left, right, tests)
    order = [*_CELLS, "tie", "spread"]
    names = [f"id_{i}" for i in range(len(identity))]
    own = "".join(f", `{c}` AS {n}" for c, n in zip(identity, names, strict=True))

    # A row becomes one for each comparison and few of them fold: a task takes its share of the rows, not a whole split.
    many_tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(many_tasks), right.repartition(many_tasks)

    def rows(side: str, carried: str, many: str) -> str:
        filled = f"filter(array({', '.join(cells[side])}), x -> x IS NOT NULL)"
        return f"SELECT `{key}` AS match_key{carried}, {many}, inline({filled}) FROM {{{side}}} WHERE `{key}` IS NOT NULL"

    none = "".join(f", CAST(NULL AS {left.schema[c].dataType.simpleString()}) AS {n}" for c, n in zip(identity, names, strict=True))
    keys = ", ".join(["match_key", "point", *_CELLS, "tie", *names])
    spread = f"xxhash64({', '.join(names)})" if names else "0L"
    folded = over({"left": left, "right": right}, f"""
        SELECT {keys}, {spread} AS spread, sum(lefts) AS lefts, sum(rights) AS rights
        FROM ({rows('left', own, '1L AS lefts, 0L AS rights')} UNION ALL {rows('right', none, '0L AS lefts, 1L AS rights')})
        GROUP BY {keys}""")
    group = ["match_key", "point"]
    position = F.struct(*order)
    # One row for each key and count with more rows than a piece, so fewer than folded rows / rows_per_piece.
    large = folded.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > rows_per_piece)
    large = large.withColumn("pieces", F.ceil(F.col("size") / rows_per_piece))
    seen = folded.join(F.broadcast(large), group).where(
        F.pmod(F.xxhash64(*group, *order), F.lit(_RANGE)) < F.col("pieces") * (SAMPLE_PER_PIECE * _RANGE) / F.col("size"))
    cuts = seen.groupBy(*group).agg(F.sort_array(F.collect_set(position)).alias("all"), F.first("pieces").alias("pieces")).select(
        *group, F.expr(f"filter(all, (x, i) -> i > 0 AND i % greatest(1, size(all) div CAST(pieces AS INT)) = 0)").alias("cuts"))
    # Cuts have a fixed width, and there are about folded rows / rows_per_piece of them.
    placed = folded.join(F.broadcast(cuts), group, "left").withColumn(
        "piece", F.coalesce(F.size(F.filter("cuts", lambda c: c <= position)), F.lit(0))).drop("cuts")
    before = Window.partitionBy(*group, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("passed", F.coalesce(F.sum("rights").over(before), F.lit(0)))
    earlier = Window.partitionBy(*group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(*group, "piece").agg(F.sum("rights").alias("own")).select(
        *group, "piece", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("carried"),
        F.sum("own").over(Window.partitionBy(*group)).alias("total"))
    share, sign = (F.element_at(F.array(*[F.lit(c[k]) for c in counts]), F.col("point") + 1) for k in ("share", "sign"))
    pairs = F.col("lefts") * (share * F.col("total") + sign * (F.col("carried") + F.col("passed")))
    test = F.element_at(F.array(*[F.lit(c["test"]) for c in counts]), F.col("point") + 1)
    met = inside.where("lefts > 0").join(carried, [*group, "piece"])
    return met.groupBy(test.alias("test"), *names).agg(F.sum(pairs).alias("violations")).where("violations <> 0").select(
        "test", *[F.col(n).alias(c) for n, c in zip(names, identity, strict=True)], "violations")
