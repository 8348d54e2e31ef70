"""Pair counts against all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loanward.operators.pairs import Meeting, match_counts

OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
       "=": lambda a, b: a == b, "<>": lambda a, b: a != b}


@pytest.mark.parametrize("rows_per_piece", [4, 500_000])
def test_all_comparisons(spark, rows_per_piece):
    r = random.Random(3)

    def rows(n):
        return [(r.choice(["a", "a", "b", "c", None]), i % 9, r.choice([None, *range(12)]), r.choice([None, 0.5, 1.0, -0.0, 0.0, 7.25]),
                 r.choice([None, "x", "y", "Z", ""])) for i in range(n)]

    kind = "k string, id int, n int, x double, t string"
    one, two = rows(70), rows(50)
    tests = {f"n{op}": [Meeting(left="n", op=op, right="n")] for op in OPS}
    tests |= {f"x{op}": [Meeting("id > 2", "n IS NOT NULL", "x", op, "n + 0.5D")] for op in OPS}
    tests |= {f"t{op}": [Meeting(left="t", op=op, right="t")] for op in ("=", "<>")}
    tests |= {"all": [Meeting()], "either": [Meeting(left="n", op="<", right="n - 2"), Meeting(left="n", op=">", right="n + 2")],
              "none": [Meeting("id > 100")]}

    def meets(name, a, b):
        if name in ("all", "none"):
            return name == "all"
        if name == "either":
            return a[2] is not None and b[2] is not None and abs(a[2] - b[2]) > 2
        if name[0] == "x" and (a[1] <= 2 or b[2] is None):
            return False
        x, y = {"n": (a[2], b[2]), "x": (a[3], None if b[2] is None else b[2] + 0.5), "t": (a[4], b[4])}[name[0]]
        return x is not None and y is not None and OPS[name[1:]](x, y)

    want, by_id = Counter(), Counter()
    for a in one:
        for b in two:
            if a[0] is not None and a[0] == b[0]:
                for name in tests:
                    if meets(name, a, b):
                        want[name] += 1
                        by_id[name, a[1]] += 1
    left, right = spark.createDataFrame(one, kind), spark.createDataFrame(two, kind)
    got = match_counts(left, right, "k", tests, rows_per_piece=rows_per_piece).collect()
    assert {r.test: r.violations for r in got} == want
    got = match_counts(left, right, "k", tests, ["id"], rows_per_piece=rows_per_piece).collect()
    assert {(r.test, r.id): r.violations for r in got} == by_id


def test_one_key_on_both_sides_is_linear(spark):
    """A million rows of one key on either side: the pairs are counted in pieces, no stage makes more rows than both sides have."""
    many = 1_000_000
    left = spark.range(many).select(F.lit(0).alias("k"), F.pmod(F.col("id") * 7919, F.lit(many)).alias("v"))
    right = spark.range(many).select(F.lit(0).alias("k"), F.pmod(F.col("id") * 104729, F.lit(many)).alias("v"))
    out = match_counts(left, right, "k", {"less": [Meeting(left="v", op="<", right="v")]}, rows_per_piece=50_000)
    assert [tuple(r) for r in out.collect()] == [("less", many * (many - 1) // 2)]


def test_empty_sides_and_types(spark):
    kind = "k int, d date, t string"
    empty, row = spark.createDataFrame([], kind), spark.sql("SELECT 1 AS k, DATE '2020-01-01' AS d, 'a' AS t")
    tests = {"d": [Meeting(left="d", op="<", right="d")]}
    assert not match_counts(empty, row, "k", tests).collect() and not match_counts(row, empty, "k", tests).collect()
    later = {"d": [Meeting(left="d", op="<", right="CAST(date_add(d, 1) AS TIMESTAMP)")]}
    assert match_counts(row, row, "k", later).first().violations == 1
    with pytest.raises(ValueError, match="cannot compare"):
        match_counts(row, row, "k", {"t": [Meeting(left="t", op="<", right="t")]})


def test_sides_are_dealt_out_before_they_multiply(spark):
    """One file or partition of many rows is not one task's to multiply and fold."""
    left = spark.range(2000).selectExpr("id % 5 AS k", "id AS a").coalesce(1)
    right = spark.range(50).selectExpr("id % 5 AS k", "id * 40 AS b").coalesce(1)
    got = match_counts(left, right, "k", {"less": [Meeting(left="a", op="<", right="b")]})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
    want = sum(1 for a in range(2000) for b in range(50) if a % 5 == b % 5 and a < b * 40)
    assert [r.violations for r in got.collect()] == [want]
