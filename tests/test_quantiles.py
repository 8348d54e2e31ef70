"""Exact quantiles against numpy, with and without cutting."""

import math
import random

import numpy as np
import pytest

from loanward.operators.quantiles import exact_quantiles

P = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def _rows(size, seed=1):
    """A group with most rows, one without values, a null group, repeated values."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.choice([None, 5.0, round(rng.lognormvariate(3, 2), 3)]), rng.randrange(-40, 40))
            for _ in range(size)]
    return [*rows, ("empty", None, 3), ("a", 1e12, None)]


def _got(df, by):
    return {(*[r[b] for b in by], r.column_name, r.probability): (r.quantile, r.value_count) for r in df.collect()}


def _want(rows, keyed, method):
    groups = {}
    for g, v, n in rows:
        for name, x in (("v", v), ("n", n)):
            if x is not None:
                groups.setdefault((g, name) if keyed else (name,), []).append(x)
    return {(*k, p): (pytest.approx(float(np.quantile(np.array(x, float), p, method=method))), len(x))
            for k, x in groups.items() for p in P}


@pytest.mark.parametrize("size,at_once", [(1, 5), (40, 5), (3000, 100_000), (3000, 40)])
@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_equal_numpy(spark, size, at_once, by):
    rows = _rows(size)
    df = spark.createDataFrame(rows, "g string, v double, n int")
    assert _got(exact_quantiles(df, by, ["v", "n"], P, sorted_values=at_once), by) == _want(rows, bool(by), "linear")


@pytest.mark.parametrize("at_once", [40, 100_000])
def test_quantiles_that_are_values(spark, at_once):
    rows = _rows(2000, 2)
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = _got(exact_quantiles(df, ["g"], ["v", "n"], P, interpolate=False, sorted_values=at_once), ["g"])
    assert got == _want(rows, True, "inverted_cdf")


def test_many_intervals_are_joined_by_pieces(spark, monkeypatch):
    """What more crowded groups than may be broadcast give is the same."""
    import loanward.operators.quantiles as q
    rows = _rows(2500, 3)
    df = spark.createDataFrame(rows, "g string, v double, n int")
    monkeypatch.setattr(q, "BROADCAST_INTERVALS", 0)
    assert _got(exact_quantiles(df, ["g"], ["v", "n"], P, sorted_values=30), ["g"]) == _want(rows, True, "linear")


def test_passes_shrink_a_large_group(spark):
    """400,000 distinct values in one group, of which ten may be sorted at once: three passes."""
    df = spark.range(400_001).selectExpr("cast(id as double) AS v")
    got = _got(exact_quantiles(df, [], ["v"], P, sorted_values=10), [])
    assert got == {("v", p): (pytest.approx(400_000 * p), 400_001) for p in P}


def test_empty_tables_nan_and_infinity(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(empty, ["g"], ["v"], [0.5]).count() == 0
    odd = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),), (float("inf"),), (math.nan,)], "v double")
    got = [r.quantile for r in exact_quantiles(odd, [], ["v"], [0, 0.25, 0.5, 0.625]).collect()]
    assert got == [float("-inf"), 1.0, float("inf"), float("inf")]
    assert math.isnan(exact_quantiles(odd, [], ["v"], [1]).first().quantile)
    with pytest.raises(ValueError):
        exact_quantiles(odd, [], ["v"], [1.5])


def test_a_slice_is_found_in_halving_steps(spark):
    """The number of cuts up to a value, among them equal ones and NaN, is that of looking at all of them."""
    import loanward.operators.quantiles as q
    rng = random.Random(4)
    lists = [[], [1.0], sorted(float(rng.randrange(40)) for _ in range(q.SLICES - 1)), [float(i) for i in range(q.SLICES - 2)] + [math.nan]]
    rows = [(cuts, v) for cuts in lists for v in [-1.0, 0.0, 1.0, 39.0, 198.0, math.inf, math.nan, *(rng.uniform(-2, 205) for _ in range(60))]]
    df = spark.createDataFrame(rows, "_cuts array<double>, v double")
    assert df.selectExpr(f"{q._SLICE} AS got", "size(filter(_cuts, c -> c <= v)) AS want").where("got <> want").count() == 0
    assert q._SLICE.count("->") == 1 and "filter" not in q._SLICE


def test_values_are_folded_once(spark, monkeypatch):
    """Passes read the folded values; the table itself is aggregated a single time."""
    import loanward.operators.quantiles as q
    frames, given = [], q._narrowed
    monkeypatch.setattr(q, "_narrowed", lambda folded, *a: frames.append(folded) or given(folded, *a))
    df = spark.createDataFrame(_rows(500, 5), "g string, v double, n int")
    assert _got(q.exact_quantiles(df, ["g"], ["v", "n"], P), ["g"]) == _want(_rows(500, 5), True, "linear")
    assert "Aggregate" not in frames[0]._jdf.queryExecution().optimizedPlan().toString()
