"""Rules judged while a table is written, and from sums of its months."""

import pytest
from pyspark.sql import functions as F

from loanward.plans.evaluate import evaluate
from loanward.plans.measures import judge_parts, measure_parts, row_rules, save_parts, write_judged
from loanward.plans.packs import CATALOGUE, FOUNDATION, RUNNER
from loanward.plans.rule import Rule, at_most

RULES = row_rules([*FOUNDATION, *RUNNER, *CATALOGUE], "payments")
DUE = "payment_due_date"


def _rows(results):
    return sorted(tuple(r) for r in results.collect())


def test_rules_of_single_rows_are_told_apart():
    ids = {r.id for r in RULES}
    assert {"FND-025", "RUN-034", "HYD-010"} <= ids and not {"FND-032", "FND-001"} & ids


@pytest.mark.parametrize("layout", [[], ["payment_status"]])
def test_a_write_gives_the_results_of_an_evaluation(spark, lending, tmp_path, layout):
    payments = lending["payments"].withColumn("extra", lending["payments"].loan_id)
    jobs = spark.sparkContext.statusTracker()
    before = set(jobs.getJobIdsForGroup(None))
    got = write_judged(payments, str(tmp_path), "payments", RULES, lending, layout)
    written = len(set(jobs.getJobIdsForGroup(None)) - before)
    assert 1 <= written <= 2  # the write, and with a layout the exchange before it
    assert _rows(got) == _rows(evaluate(RULES, lending))
    back = spark.read.parquet(str(tmp_path / "payments.parquet"))
    assert back.count() == payments.count() and set(back.columns) == set(payments.columns)


def test_an_empty_table_and_a_missing_column(spark, lending, tmp_path):
    none = lending["payments"].limit(0)
    assert _rows(write_judged(none, str(tmp_path), "payments", RULES, lending)) == _rows(evaluate(RULES, lending.replace(payments=none)))
    less = lending["payments"].drop("returned_flag")
    got = {r.rule_id: r.status for r in write_judged(less, str(tmp_path), "payments", RULES, lending).collect()}
    assert got["HYD-010"] == "SKIP" and got["HYD-008"] != "SKIP"


def test_rules_over_several_tables_are_refused(lending, tmp_path):
    with pytest.raises(ValueError, match="FND-001"):
        write_judged(lending["payments"], str(tmp_path), "payments", [FOUNDATION.rule("FND-001")], lending)


def test_months_add_up_and_late_ones_are_replaced(spark, lending, tmp_path):
    payments = lending["payments"]
    undated = payments.limit(5).withColumn(DUE, F.lit(None).cast("date"))
    first = lending.replace(payments=payments.unionByName(undated))
    path = str(tmp_path / "state")
    save_parts(measure_parts(RULES, first, "payments", DUE), path)
    assert _rows(judge_parts(RULES, first, "payments", path)) == _rows(evaluate(RULES, first))
    # One month loses rows, one gets rows twice, one goes, and the rows without date go.
    month = "date_format(payment_due_date, 'yyyy-MM')"
    later = payments.filter(f"NOT ({month} = '2023-05' AND nsf_flag) AND {month} <> '2023-06'").unionByName(
        payments.filter(f"{month} = '2023-07'"))
    second = first.replace(payments=later)
    late = ["2023-05", "2023-06", "2023-07", "undated"]
    delta = measure_parts(RULES, second, "payments", DUE, late)
    assert {r.part for r in delta.collect()} == set(late)
    save_parts(delta, path)
    assert _rows(judge_parts(RULES, second, "payments", path)) == _rows(evaluate(RULES, second))


def test_a_rule_that_the_state_does_not_hold_is_no_pass(spark, lending, tmp_path):
    path = str(tmp_path / "state")
    save_parts(measure_parts(RULES[:3], lending, "payments", DUE), path)
    with pytest.raises(Exception, match="not in the state"):
        judge_parts(RULES, lending, "payments", path).collect()


def test_rules_that_sum_the_same_count_once(spark, lending, tmp_path):
    rules = [Rule("A", "", "payments", "TRUE", "K04", at_most(0.5)), Rule("B", "", "payments", "TRUE", "K04")]
    path = str(tmp_path / "state")
    save_parts(measure_parts(rules, lending, "payments", DUE), path)
    assert _rows(judge_parts(rules, lending, "payments", path)) == _rows(evaluate(rules, lending))
