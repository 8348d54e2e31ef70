"""The worst offenders of a pack against the drill-down of single rules."""

import pytest
from pyspark.sql import functions as F

from loanward.plans.drilldown import worst_offenders
from loanward.plans.evaluate import evaluate, offenders
from loanward.plans.packs import RUNNER
from loanward.plans.packs.runner import RUNNER_EXCESS
from loanward.plans.relations import RELATIONS
from loanward.sources.tables import Tables

IDS = ("RUN-001", "RUN-005", "RUN-023", "RUN-037", "RUN-043", "RUN-046", "RUN-058", "RUN-060")
COLUMNS = ["rule_id", "variant", "place", "who", "excess", "violations"]


def _named(rule, tables):
    """Offenders by name, worst first."""
    keys = [rule.distinct] if rule.distinct else RELATIONS[rule.relation].identity
    out = {}
    for row in offenders(rule, tables).collect():
        who = ", ".join(f"{k}={'null' if row[k] is None else row[k]}" for k in keys)
        out[who] = row.violations
    return sorted(((v, w) for w, v in out.items() if v > 0), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("limit", [3, 900])
def test_every_rule_has_the_offenders_of_its_own_drill_down(lending, limit):
    rules = RUNNER.select(IDS)
    found = {}
    for r in sorted(worst_offenders(rules, lending, limit=limit).collect(), key=lambda r: (r.rule_id, r.place)):
        found.setdefault(r.rule_id, []).append((r.violations, r.who))
    assert found == {r.id: _named(r, lending)[:limit] for r in rules if _named(r, lending)}
    assert len(found) > 3


def test_the_highest_excess_comes_first(lending):
    rows = worst_offenders(RUNNER.select(("RUN-037", "RUN-043")), lending, RUNNER_EXCESS, 5).collect()
    for rule in ("RUN-037", "RUN-043"):
        own = sorted((r for r in rows if r.rule_id == rule), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        assert [r.excess for r in own] == sorted((r.excess for r in own), reverse=True)
        assert all(r.excess > 0 for r in own)


def test_pairs_of_crowded_keys_are_counted(lending):
    """A placeholder application that loans and applications both repeat."""
    names = ("applications", "loan_tape")
    frames = {n: lending[n].unionByName(lending[n].limit(60).withColumn("application_id", F.lit("NONE"))).persist() for n in names}
    rules = RUNNER.select(("RUN-001", "RUN-007", "RUN-022"))

    def worst(keys):
        tables = lending.replace(**frames)
        tables.crowded = lambda *names: keys
        return [tuple(r) for r in worst_offenders(rules, tables, limit=50).orderBy("rule_id", "place").collect()]

    pairs = worst([])
    assert worst(["NONE"]) == pairs and max(r[-1] for r in pairs) > 1


def test_only_failing_rules_and_no_rows_of_rules_that_cannot_run(lending):
    rules = RUNNER.select(("RUN-037", "RUN-043"))
    judged = evaluate(rules, lending).selectExpr("rule_id", "variant", "if(rule_id = 'RUN-043', 'PASS', status) AS status")
    assert {r.rule_id for r in worst_offenders(rules, lending, results=judged).collect()} == {"RUN-037"}
    absent = Tables({n: f for n, f in lending.items() if n != "payments"})
    assert {r.rule_id for r in worst_offenders(rules, absent).collect()} == {"RUN-043"}
    none = lending.replace(payments=lending["payments"].limit(0), credit_reports=lending["credit_reports"].limit(0))
    assert worst_offenders(rules, none).collect() == []
    nothing = worst_offenders([], lending)
    assert nothing.columns == COLUMNS and nothing.collect() == []


def test_names_are_null_where_the_identity_is(spark, lending):
    reports = lending["credit_reports"].selectExpr(
        *["CAST(NULL AS STRING) AS credit_report_id" if c == "credit_report_id" else c for c in lending["credit_reports"].columns])
    rows = worst_offenders([RUNNER.rule("RUN-043")], lending.replace(credit_reports=reports)).collect()
    assert [r.who for r in rows] == ["credit_report_id=null"]


def test_tasks_keep_their_worst_before_they_meet(lending):
    plan = worst_offenders(RUNNER.select(("RUN-037", "RUN-038", "RUN-034")), lending, RUNNER_EXCESS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert plan.count("Generate inline") == 1  # the three rules share a scan


def test_rows_are_put_together_by_key_before_they_become_one_for_each_rule(lending):
    plan = worst_offenders(RUNNER.select(("RUN-037", "RUN-038", "RUN-034")), lending, RUNNER_EXCESS)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.rindex("Exchange hashpartitioning")


@pytest.mark.parametrize("limit", [2, 900])
def test_rules_that_count_loans_share_the_window_of_those_that_count_snapshots(lending, limit):
    rules = RUNNER.select(("RUN-023", "RUN-054", "RUN-055", "RUN-056"))
    ranked = worst_offenders(rules, lending, limit=limit)
    assert ranked._jdf.queryExecution().executedPlan().toString().count(" Window [") == 2  # the steps and the ranks
    found = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.rule_id, r.place)):
        found.setdefault(r.rule_id, []).append((r.violations, r.who))
    assert found == {r.id: _named(r, lending)[:limit] for r in rules if _named(r, lending)}


def test_null_and_its_text_are_one_name_and_a_rule_given_twice_counts_twice(lending):
    reports = lending["credit_reports"].filter("open_trades_count > all_trades_count").limit(3)
    named = reports.withColumn("credit_report_id", F.expr("CASE WHEN application_id IS NULL THEN NULL ELSE 'null' END"))
    tables = lending.replace(credit_reports=named.unionByName(named.withColumn("credit_report_id", F.lit(None).cast("string"))))
    rule = RUNNER.rule("RUN-043")
    assert [(r.who, r.violations) for r in worst_offenders([rule], tables).collect()] == [("credit_report_id=null", 6)]
    assert [(r.who, r.violations) for r in worst_offenders([rule, rule], tables).collect()] == [("credit_report_id=null", 12)]
