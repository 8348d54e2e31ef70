"""Facts and proofs from footers, against scans."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loanward.sources.footers import Bound, column_facts, judge_bounds, pushed, unproved


@pytest.fixture
def path(spark, tmp_path):
    """Ten row groups of 1,000 rows each, sorted by n; z has no nulls, s and x have some."""
    n = list(range(10_000))
    rows = pa.table({"n": pa.array(n, pa.int64()), "z": pa.array([i % 50 for i in n], pa.int32()),
                     "x": pa.array([None if i % 7 == 0 else i / 2 for i in n], pa.float64()),
                     "s": pa.array([None if i == 3 else str(i) for i in n])})
    pq.write_table(rows, tmp_path / "t.parquet", row_group_size=1000)
    return str(tmp_path / "t.parquet")


def _rows_read(df):
    """Rows that the scan of a run query gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.getClass().getSimpleName():
        plan = plan.finalPhysicalPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
        if "QueryStage" in plan.getClass().getSimpleName():
            plan = plan.plan()
    return plan.metrics().apply("numOutputRows").value()


def test_facts_come_from_footers(spark, path):
    facts = column_facts(spark, path)
    assert facts.from_footers and facts.rows == 10_000
    assert facts.nulls == {"n": 0, "z": 0, "x": 1429, "s": 1}
    assert (facts.low, facts.high) == ({"n": 0, "z": 0, "x": 0.5, "s": None}, {"n": 9999, "z": 49, "x": 4999.5, "s": None})
    plan = pushed(spark, path, ["n", "z"])
    assert "PushedAggregation: [COUNT(*), COUNT(n), MIN(n), MAX(n), COUNT(z), MIN(z), MAX(z)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_missing_statistics_are_scanned(spark, tmp_path):
    pq.write_table(pa.table({"n": pa.array([3, None, 5], pa.int64())}), tmp_path / "t.parquet", write_statistics=False)
    facts = column_facts(spark, str(tmp_path / "t.parquet"))
    assert not facts.from_footers and (facts.rows, facts.nulls, facts.low, facts.high) == (3, {"n": 1}, {"n": 3}, {"n": 5})


def test_nested_columns_and_empty_tables(spark, tmp_path):
    spark.sql("SELECT 1 AS a, array(1, 2) AS v UNION ALL SELECT 2, NULL").write.parquet(str(tmp_path / "n"))
    facts = column_facts(spark, str(tmp_path / "n"))
    assert facts.nulls == {"a": 0, "v": 1} and facts.low == {"a": 1, "v": None}
    spark.sql("SELECT 1 AS a, 'x' AS s WHERE false").write.parquet(str(tmp_path / "e"))
    facts = column_facts(spark, str(tmp_path / "e"))
    assert (facts.rows, facts.nulls, facts.low) == (0, {"a": 0, "s": 0}, {"a": None, "s": None})
    assert judge_bounds(spark, str(tmp_path / "e"), [Bound("a", 5, 6, False)]).first().proved


def test_bounds_that_hold_take_no_scan(spark, path):
    asked = [Bound("n", 0, 9999, False), Bound("z", 0, 49), Bound("z", nulls=False), Bound("x", 0.5), Bound("s", nulls=False),
             Bound("n", 100), Bound("n", 0, 8999), Bound("x", 0, 4000), Bound("x", nulls=False)]
    got = [(r.proved, r.violations) for r in judge_bounds(spark, path, asked).collect()]
    assert got == [(True, 0), (True, 0), (True, 0), (True, 0), (False, 1), (False, 100), (False, 1000), (False, 1713), (False, 1429)]


def test_row_groups_inside_the_bounds_stay_unread(spark, path):
    one = unproved(spark, path, [Bound("n", 100), Bound("n", 0, 8999)])
    assert one.first() == (100, 1000)
    assert _rows_read(unproved(spark, path, [Bound("n", 100), Bound("n", 0, 8999)])) <= 2000
    assert _rows_read(unproved(spark, path, [Bound("n", 0, 5)])) > 8000


def test_nan_is_above_every_bound(spark, tmp_path):
    pq.write_table(pa.table({"x": pa.array([1.0, float("nan"), 2.0])}), tmp_path / "t.parquet")
    rows = judge_bounds(spark, str(tmp_path / "t.parquet"), [Bound("x", 0, 5), Bound("x", 0)]).collect()
    assert [(r.proved, r.violations) for r in rows] == [(False, 1), (True, 0)]
