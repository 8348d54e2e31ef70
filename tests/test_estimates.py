"""Violations estimated from sampled families."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.plans.estimates import estimates
from loanward.plans.evaluate import evaluate
from loanward.plans.packs import FOUNDATION
from loanward.plans.rule import Rule, at_most
from loanward.sources.tables import Tables

LATE = Rule("LATE", "", "loan_tape", "days_past_due > 0", "K04")


@pytest.fixture(scope="module")
def families(spark):
    """400 applications with 1 to 12 loan rows each; a third of the applications has late rows, and many."""
    apps = spark.range(400).selectExpr("concat('A', id) AS application_id", "id")
    loans = apps.selectExpr("application_id", "concat('L', id) AS loan_id", "id", "explode(sequence(1, CAST(1 + id % 12 AS INT))) AS k").selectExpr(
        "application_id", "loan_id", "CAST(if(id % 3 = 0 AND k % 4 > 0, 30, 0) AS INT) AS days_past_due")
    return Tables({"applications": apps.drop("id").persist(), "loan_tape": loans.persist()})


def test_all_families_give_the_results_of_an_evaluation(lending):
    got = {r.rule_id: r for r in estimates(FOUNDATION, lending, 1.0).collect()}
    want = {r.rule_id: r for r in evaluate(FOUNDATION, lending).collect()}
    judged = {i for i, r in got.items() if r.status != "SKIP"}
    assert set(got) == set(want) and set(want) - judged == {"FND-021"}
    for i in judged:
        assert (got[i].sampled, got[i].estimate, got[i].low, got[i].high) == (want[i].violations,) + (float(want[i].violations),) * 3, i
        assert got[i].status == want[i].status, i


def test_intervals_hold_the_full_count_at_their_rate(families):
    full = evaluate([LATE], families).first().violations
    seeds = 40
    runs = reduce(DataFrame.unionByName, [estimates([LATE], families, 0.4, seed) for seed in range(seeds)]).collect()
    assert len(runs) == seeds and len({r.estimate for r in runs}) > 20
    assert sum(r.low <= full <= r.high for r in runs) >= 0.85 * seeds
    assert abs(sum(r.estimate for r in runs) / seeds - full) < 0.08 * full
    assert all(r.status == "FAIL" for r in runs)


def test_shares_are_judged_by_their_own_error(families):
    rows = families["loan_tape"].agg(F.avg((F.col("days_past_due") > 0).cast("int"))).first()[0]
    rules = [Rule("FAR", "", "loan_tape", LATE.predicate, "K04", at_most(rows * 3)), Rule("NEAR", "", "loan_tape", LATE.predicate, "K04", at_most(rows)),
             Rule("OVER", "", "loan_tape", LATE.predicate, "K04", at_most(rows / 3))]
    assert {r.rule_id: r.status for r in estimates(rules, families, 0.4).collect()} == {"FAR": "PASS", "NEAR": "OPEN", "OVER": "FAIL"}


def test_nothing_seen_is_no_pass(families):
    never = Rule("NEVER", "", "loan_tape", "days_past_due > 99", "K04")
    row = estimates([never], families, 0.1).first()
    assert (row.sampled, row.estimate, row.low, row.high, row.status) == (0, 0.0, 0.0, 29.0, "OPEN")
    assert estimates([never], families, 1.0).first().status == "PASS"
    none = families.replace(loan_tape=families["loan_tape"].limit(0))
    assert estimates([never], none, 0.1).first().high == 29.0


def test_orphans_count_as_they_are_and_keys_once(spark, families):
    payments = families["loan_tape"].selectExpr("concat(loan_id, '-', days_past_due) AS payment_id", "loan_id", "'MISSED' AS payment_status").unionByName(
        spark.range(7).selectExpr("concat('X', id) AS payment_id", "concat('X', id) AS loan_id", "'MISSED' AS payment_status"))
    tables = families.replace(payments=payments)
    orphans = Rule("ORPHAN", "", "payments", "loan_id LIKE 'X%'", "K04")
    row = estimates([orphans], tables, 0.3).first()
    assert (row.sampled, row.estimate, row.low, row.high) == (7, 7.0, 7.0, 7.0)
    keyed = Rule("KEYS", "", "loan_tape", LATE.predicate, "K04", distinct="loan_id")
    plain, once = sorted(estimates([LATE, keyed], tables, 1.0).collect(), key=lambda r: -r.estimate)
    assert once.rule_id == "KEYS" and once.estimate == families["loan_tape"].filter(LATE.predicate).select("loan_id").distinct().count()


def test_rules_without_families_or_input_are_skipped(lending):
    rules = [FOUNDATION.rule("FND-021"), FOUNDATION.rule("FND-034")]
    less = Tables({n: f for n, f in lending.items() if n != "payments"})
    assert {r.rule_id: r.status for r in estimates(rules, less, 0.5).collect()} == {"FND-021": "SKIP", "FND-034": "SKIP"}
