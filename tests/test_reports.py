"""Reports on a small result set."""

import pytest

from loanward.plans.packs import FOUNDATION, RUNNER
from loanward.plans.packs.foundation import CATEGORIES
from loanward.reports import results as rp

SCHEMA = ("rule_id string, title string, status string, violations long, tolerance double, details string, "
          "severity string, category string, variant string, matching long, base long")


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([
        ("FND-001", "a", "PASS", 0, 0.0, "", "CRITICAL", "Lifecycle", "code", 0, None),
        ("FND-009", "b", "FAIL", 7, 0.0, "7 violations", "CRITICAL", "State", "code", 7, None),
        ("FND-058", "c", "PASS", 4, 50.0, "", "HIGH", "State", "code", 4, 1000),
        ("FND-059", "d", "FAIL", 40, 10.0, "", "MEDIUM", "State", "code", 40, 1000),
        ("FND-060", "e", "SKIP", -1, None, "table x not found", "HIGH", "State", "code", None, None)], SCHEMA)


def test_layouts(results):
    assert rp.foundation_report(results).columns == [
        "Check ID", "Check Name", "Status", "Violations", "Tolerance", "Details", "Severity"]
    assert rp.extended_report(results).columns == [
        "Check ID", "Check Name", "Status", "Violations", "Severity", "Details"]
    runner = {r.Check_ID: (r.Violations, r.Status) for r in rp.runner_report(results).collect()}
    assert runner["FND-060"] == (-1, "SKIP: table x not found") and runner["FND-009"] == (7, "FAIL")


def test_totals_leave_skipped_rules_out_of_the_rate(results):
    row = rp.totals(results).first()
    assert (row.total, row.evaluated, row.passed, row.failed, row.skipped, row.violations) == (5, 4, 2, 2, 1, 47)
    assert row.pass_rate == 50.0


def test_lists_groups_and_gate(results):
    assert {r.rule_id for r in rp.failed(results).collect()} == {"FND-009", "FND-059"}
    assert [r.details for r in rp.skipped(results).collect()] == ["table x not found"]
    assert [(r.severity, r.status, r.rules) for r in rp.by_severity(results).collect()][:2] == [
        ("CRITICAL", "FAIL", 1), ("CRITICAL", "PASS", 1)]
    assert {r.category: (r.passed, r.evaluated) for r in rp.by_category(results).collect()} == {
        "Lifecycle": (1, 1), "State": (1, 3)}
    ranges, low = [], 1
    for last, name in CATEGORIES:
        ranges.append((low, last, name))
        low = last + 1
    assert {r.category: r.evaluated for r in rp.by_number_range(results, ranges).collect()} == {
        "Lifecycle": 1, "State Machine": 1, "State": 2}
    assert not rp.gate(results) and rp.exit_code(results) == 1
    assert rp.gate(results.filter("status <> 'FAIL'"))


def test_categories_partition_the_rules():
    assert all(r.category for r in (*FOUNDATION, *RUNNER))
    assert len({r.category for r in FOUNDATION}) == 8


def test_sign_off(results):
    got = {r.severity: (r.rules_over, r.status) for r in rp.sign_off(results).collect()}
    assert got == {"CRITICAL": (1, "FAIL"), "HIGH": (0, "PASS"), "MEDIUM": (0, "PASS")}


def test_versions_are_compared(results):
    later = results.replace({7: 0}, subset=["violations"])
    row = rp.compare({"v1": results, "v2": later}).filter("rule_id = 'FND-009'").first()
    assert (row.v1_violations, row.v2_violations, row.delta, row.reduction_pct) == (7, 0, -7, 100.0)
    skipped = rp.compare({"v1": results, "v2": later}).filter("rule_id = 'FND-060'").first()
    assert skipped.delta is None


def test_csv_has_a_header(results, tmp_path):
    rp.save_csv(rp.runner_report(results), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text().splitlines()
    assert text[0] == "Check_ID,Check_Name,Violations,Status" and len(text) == 6


def test_examples_are_the_worst(lending):
    rows = rp.examples(RUNNER.rule("RUN-043"), lending, "open_trades_count - all_trades_count", 5).collect()
    assert len(rows) == 5 and [r.excess for r in rows] == sorted((r.excess for r in rows), reverse=True)
