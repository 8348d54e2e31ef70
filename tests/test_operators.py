"""Operators against brute force on small frames, with nulls, ties and forced hot keys."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loanward.operators import keys as ks
from loanward.operators import profile as pf
from loanward.operators.joins import weighted_join
from loanward.operators.skew import (
    ROWS_PER_PIECE, HotKeys, _by_pieces, _split_points, hot_keys, skew_join, unfold, with_previous)


@pytest.fixture(scope="module")
def steps(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "a", "b", "c", None]), rng.choice([None, 1, 2, 3, 3, 3, 4]),
             rng.choice(["x", "y", "z", None])) for _ in range(1500)]
    return rows, spark.createDataFrame(rows, "k string, o int, s string")


def _previous_by_hand(rows):
    out = Counter()
    rank = lambda r: tuple((v is not None, v) for v in r[1:])
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    for members in groups.values():
        members.sort(key=rank)
        previous = opened = None
        for row in members:
            out[(*row, previous is not None, *(previous or (None, None, None))[1:],
                 *(opened or (None, None, None))[1:])] += 1
            previous = row
            if row[2] == "x":
                opened = row
    return out


@pytest.mark.parametrize("hot", [(), ("a",), ("a", None), ("a", "b", "c", None)])
def test_previous_row_is_the_same_with_and_without_hot_keys(steps, hot):
    rows, df = steps
    out = with_previous(df, "k", ["o"], ["o", "s"], hot, pieces=7, also={"q_": "s = 'x'"})
    got = Counter()
    for r in out.select("k", "o", "s", "has_prev", "prev_o", "prev_s", "q_o", "q_s", "_n").collect():
        got[tuple(r[:-1])] += r[-1]
    assert got == _previous_by_hand(rows)


def test_hot_keys_are_found_and_bounded(spark, steps):
    _, df = steps
    assert set(hot_keys(df, "k", 500)) == {"a"}
    assert hot_keys(df, "k", 2000) == []
    assert None in hot_keys(df, "k", 100)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_salted_join_equals_plain_join(spark, steps, how):
    _, df = steps
    dim = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("d", 4), (None, 5)], "k string, v int")
    order = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert order(skew_join(df, dim, "k", how, ["a", None], pieces=5)) == order(df.join(dim, ["k"], how))


def test_weighted_join_counts_pairs(spark):
    left = spark.createDataFrame([("a", 1)] * 30 + [("b", 2)], "k string, x int")
    right = spark.createDataFrame([("a", "p")] * 20 + [("a", "q"), ("b", "p")], "k string, y string")
    pairs = weighted_join(left, right, "k", "r_", fold_left=True, fold_right=True)
    assert pairs.count() == 3
    assert pairs.agg(F.sum("_n")).first()[0] == left.join(right, "k").count()


def test_null_keys_are_orphans_and_count_as_a_value(spark):
    child = spark.createDataFrame([("a",), ("z",), (None,), (None,)], "k string")
    parent = spark.createDataFrame([("a",), (None,)], "k string")
    assert sorted(r[0] or "" for r in ks.orphans(child, parent, "k").collect()) == ["", "", "z"]
    assert {r.k: r.violations for r in ks.orphan_counts(child, parent, "k").collect()} == {"z": 1, None: 2}
    assert ks.surplus_rows(child, "k").first()[0] == 1
    parity = ks.key_parity(child, parent, "k").first()
    assert (parity.n_left, parity.n_right) == (3, 2)


def test_cardinality_lists_keys_without_children(spark):
    parent = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    child = spark.createDataFrame([("a",), ("a",)], "k string")
    assert {r.k: r.children for r in ks.cardinality(parent, child, "k").collect()} == {"a": 2, "b": 0}


@pytest.mark.parametrize("size", [1, 2, 7, 500])
def test_median_is_exact(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, round(rng.lognormvariate(3, 2), 2), 5.0])) for _ in range(size)]
    rows.append(("a", 1e12))
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    got = {r.g: r.median for r in pf.exact_median(df, ["g"], "v").collect()}
    assert got == pytest.approx({g: statistics.median(v) for g, v in want.items()})
    overall = pf.exact_median(df, [], "v").first().median
    assert overall == pytest.approx(statistics.median([v for _, v in rows if v is not None]))


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "x int, y double")
    assert pf.correlation(df, "x", "y").first().correlation is None


def test_shares_and_rates_of_nothing(spark):
    empty = spark.createDataFrame([], "x int")
    assert pf.shares(empty, "x").count() == 0
    assert pf.rate(empty, "x = 1").first().pct is None


def test_null_profile_covers_all_columns(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "x int, y string")
    assert {r.column_name: r.null_pct for r in pf.null_profile(df).collect()} == {"x": 50.0, "y": 100.0}


def test_schema_gaps(spark):
    df = spark.createDataFrame([(1, 2)], "x int, z int")
    assert {(r.column_name, r.gap) for r in pf.schema_gaps(df, ["x", "y"], "t").collect()} == {
        ("y", "MISSING"), ("z", "EXTRA")}


def test_every_hot_key_is_cut(spark):
    """2,000 hot keys, each with its own cuts, give the plain window's answers."""
    rows = spark.range(40_000).selectExpr("id % 2000 AS k", "id AS at", "id * 7 % 11 AS v")
    hot = HotKeys({k: 20 for k in range(2000)})
    cuts = _split_points(rows, "k", ["at"], hot, 4)
    assert cuts.filter("size(_cuts) >= 2").count() == 2000
    want = with_previous(rows, "k", ["at"], ["v"]).select("k", "at", "prev_v", "_n")
    got = with_previous(rows, "k", ["at"], ["v"], hot, pieces=4).select("k", "at", "prev_v", "_n")
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_unfold_gives_every_copy(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 1L), ('b', 0L), ('c', 10007L) AS t(x, _n)")
    assert {r.x: r["count"] for r in unfold(rows).groupBy("x").count().collect()} == {"a": 1, "c": 10007}


def test_larger_hot_keys_get_more_pieces():
    groups = _by_pieces(HotKeys({"a": 10, "b": 100 * ROWS_PER_PIECE}), 64)
    assert groups == {64: ["a"], 128: ["b"]}
