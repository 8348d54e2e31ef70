"""Evaluation: tolerance modes, skipping, fusion, variants, user rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanward.plans.bindings import KINDS
from loanward.plans.evaluate import evaluate, evaluate_one_by_one, offenders, violations
from loanward.plans.packs import ALL_PACKS, CATALOGUE, FOUNDATION, NAMED, REDUCED, RUNNER
from loanward.plans.rule import Base, Relation, Rule, Tolerance, at_most, band, below
from loanward.plans.meetings import MEETINGS, SIDES
from loanward.sources.tables import Tables


def _by_id(df):
    return {r.rule_id: r for r in df.collect()}


def test_packs_are_complete():
    assert (len(FOUNDATION), len(RUNNER), len(CATALOGUE)) == (60, 60, 87)
    assert len(NAMED) == 207 and len({r.id for r in NAMED}) == 207
    assert len(REDUCED) == 29
    assert len({r.kind for r in NAMED}) >= 30


@pytest.fixture(scope="module")
def numbers(spark):
    return Tables({"loan_tape": spark.range(100).selectExpr("CAST(id AS STRING) AS loan_id", "CAST(id AS INT) AS days_past_due")})


def _rule(tolerance, predicate="days_past_due < 5", **more):
    return Rule("X-001", "x", "loan_tape", predicate, "K04", tolerance, **more)


@pytest.mark.parametrize("tolerance, status", [
    (Tolerance(limit=5), "PASS"), (Tolerance(limit=4), "FAIL"),
    (at_most(0.05), "PASS"), (at_most(0.059), "PASS"), (at_most(0.049), "FAIL"), (at_most(0.001, minimum=5), "PASS"),
    (below(0.05), "FAIL"), (below(0.051), "PASS"),
    (band(5, 10), "PASS"), (band(5.1, 10), "WARN"), (Tolerance("info"), "INFO"),
])
def test_tolerance_modes_at_their_edges(numbers, tolerance, status):
    row = evaluate([_rule(tolerance)], numbers).first()
    assert row.status == status and row.matching == 5


def test_a_band_without_rows_is_skipped(numbers):
    row = evaluate([_rule(band(1, 2), base=Base("loan_tape", "days_past_due > 1000"))], numbers).first()
    assert (row.status, row.violations) == ("SKIP", -1)


def test_null_predicates_are_no_violation(spark):
    t = Tables({"loan_tape": spark.sql("SELECT CAST(NULL AS STRING) AS loan_id, CAST(NULL AS INT) AS days_past_due, "
                                       "CAST(NULL AS STRING) AS loan_status")})
    rules = [_rule(Tolerance(), p) for p in ("days_past_due < 5", "NOT (days_past_due BETWEEN 1 AND 2)",
                                             "loan_status NOT IN ('CURRENT')")]
    assert [r.matching for r in evaluate_one_by_one(rules, t).collect()] == [0, 0, 0]


def test_empty_tables_give_zero(spark, lending):
    empty = Tables({n: df.limit(0) for n, df in lending.items()})
    rows = evaluate(FOUNDATION, empty).collect()
    assert {r.matching for r in rows} == {0} and {r.status for r in rows if r.rule_id != "FND-053"} == {"PASS"}


def test_missing_table_and_column_skip_with_a_reason(lending):
    less = {n: df for n, df in lending.items() if n != "fraud_verification"}
    less["payments"] = less["payments"].drop("scheduled_payment_amount_calc", "payment_received_date")
    less["loan_tape"] = less["loan_tape"].drop("original_apr", "first_payment_due_date", "original_loan_amount")
    got = _by_id(evaluate([*FOUNDATION, *RUNNER, *CATALOGUE], Tables(less)))
    reasons = {i: r.details for i, r in got.items() if r.status == "SKIP"}
    assert {i for i in reasons if i.startswith("FND")} == {
        "FND-003", "FND-009", "FND-010", "FND-015", "FND-018", "FND-020", "FND-021", "FND-023", "FND-026", "FND-027",
        "FND-030", "FND-031", "FND-047", "FND-048", "FND-049", "FND-050"}
    assert {"RUN-035", "RUN-036", "RUN-046", "POL-005", "FIN-006"} <= set(reasons)
    assert reasons["RUN-035"] == "column scheduled_payment_amount_calc not found"
    assert reasons["FND-003"] == "table fraud_verification not found"
    assert {r.violations for r in got.values() if r.status == "SKIP"} == {-1}
    assert got["FND-012"].status in ("PASS", "FAIL")


def test_fused_equals_one_by_one_equals_offenders(lending):
    """The ledgers and shared joins count what the violating rows add up to."""
    picked = [r for r in (*FOUNDATION, *RUNNER, *CATALOGUE) if r.count or r.relation in ("payment_marks", "loan_steps")]
    seen, rules = set(), []
    for r in picked:
        if (r.relation, r.predicate) not in seen:
            seen.add((r.relation, r.predicate))
            rules.append(r)
    fused = _by_id(evaluate(rules, lending))
    for rule in rules:
        rows = offenders(rule, lending).agg({"violations": "sum"}).first()[0] or 0
        assert rows == fused[rule.id].matching, rule.id
    few = [r for r in rules if r.id in ("FND-002", "FND-009", "FND-054", "RUN-057")]
    alone = _by_id(evaluate_one_by_one(few, lending))
    assert {i: alone[i].matching for i in alone} == {r.id: fused[r.id].matching for r in few}


def test_hot_keys_do_not_change_results(lending):
    forced = Tables(dict(lending), hot_min_rows=3)
    assert forced.hot("loan_tape", "loan_id") and forced.hot("payments", "loan_id")
    for pack in (FOUNDATION, ALL_PACKS["catalogue_spec"], ALL_PACKS["runner_spec"]):
        plain = {(r.rule_id, r.variant): r.matching for r in evaluate(pack, lending).collect()}
        split = {(r.rule_id, r.variant): r.matching for r in evaluate(pack, forced).collect()}
        assert plain == split


def _copied(tables, spare=()):
    """Every table with 0 to 3 further copies of its rows."""
    frames = {}
    for name, df in tables.items():
        turn = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if kind not in spare]), F.lit(4))
        frames[name] = df.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), turn))).drop("_t")
    return frames


def test_copies_under_hot_keys_do_not_change_rules(lending):
    frames = {n: df.limit(400) for n, df in lending.items()}
    copies = _copied({n: df.cache() for n, df in frames.items()})
    plain, forced = Tables(copies), Tables(copies, hot_min_rows=3)
    assert forced.hot("loan_tape", "loan_id")
    for pack in (FOUNDATION, ALL_PACKS["runner_spec"]):
        want = {(r.rule_id, r.variant): r.matching for r in evaluate(pack, plain).collect()}
        assert want == {(r.rule_id, r.variant): r.matching for r in evaluate(pack, forced).collect()}


def test_copies_under_hot_keys_do_not_change_rule_kinds(spark, small):
    names = ("customer", "supplier", "orders", "lineitem", "events", "documents", "labels")
    frames = {n: spark.read.parquet(f"{small}/{n}.parquet").limit(300) for n in names}
    copies = _copied({n: df.cache() for n, df in frames.items()})
    plain, forced = Tables(copies), Tables(copies, hot_min_rows=3)
    assert forced.hot("orders", "o_custkey") and forced.hot("events", "user_id")
    for name in ("k02_conditional_existence", "k03_joined_predicate", "k10_conditional_not_null", "k11_event_after_anchor",
                 "k14_terminal_state", "k15_monotonic_measure", "k16_sequence_gap", "k17_latest_snapshot",
                 "k22_cross_table_value", "k27_null_profile", "k30_amortization", "k32_flag_against_existence",
                 "k34_age_at_event"):
        want, got = (sorted(map(repr, KINDS[name](t).collect())) for t in (plain, forced))
        assert want == got, name


def test_an_unknown_column_skips_its_rule_only(numbers):
    rules = [_rule(Tolerance()), _rule(Tolerance(), "no_such_thing > 5")]
    found = sorted((r.status, r.details) for r in evaluate(rules, numbers).collect())
    assert found == [("FAIL", "5 violations"), ("SKIP", "column no_such_thing not found")]


def test_one_scan_per_table_for_row_rules(lending):
    rules = [r for r in NAMED if r.relation == "loan_tape"]
    plan = evaluate(rules, lending)._jdf.queryExecution().optimizedPlan().toString()
    assert len(rules) > 40 and plan.count("Relation [") == 1


def test_as_of_date_is_a_parameter(lending):
    rule = [RUNNER.rule("RUN-018")]
    late = Tables(dict(lending), as_of=dt.date(2030, 1, 1))
    assert evaluate(rule, lending).first().matching > 0 and evaluate(rule, late).first().matching == 0


def test_violations_are_rows_of_the_relation(lending):
    rows = violations(FOUNDATION.rule("FND-012"), lending)
    assert "loan_status" in rows.columns and {r.loan_status for r in rows.select("loan_status").distinct().collect()} == {"CURRENT"}
    with pytest.raises(ValueError, match="not found"):
        violations(FOUNDATION.rule("FND-012"), Tables({"applications": lending["applications"]}))


def test_user_defined_rule_and_relation(spark):
    t = Tables({"things": spark.sql("SELECT * FROM VALUES ('a', 1), ('b', -1) AS t(name, size)")})
    relations = {"things": Relation("things", {"things": ("size",)}, lambda x: x["things"], ("name",))}
    rule = Rule("U-1", "it's \\ sized", "things", "size < 0", "K04", columns=("size",))
    row = evaluate([rule], t, relations).first()
    assert (row.status, row.violations, row.title) == ("FAIL", 1, "it's \\ sized")
    assert offenders(rule, t, relations).collect() == [("b", 1)]


def _placeholder(tables):
    """Rows of all two-sided joins moved to one id per join, so that it stands on both sides with different rows."""
    moved = {"loan_tape": "application_id", "applications": "application_id", "credit_reports": "application_id",
             "fraud_verification": "application_id", "credit_tradelines": "credit_report_id"}
    frames = dict(tables)
    for name, key in moved.items():
        df = frames[name]
        turn = F.pmod(F.xxhash64(*df.columns), F.lit(9))
        frames[name] = df.withColumn(key, F.when(turn == 0, F.lit("NONE").cast(df.schema[key].dataType)).otherwise(F.col(key)))
    reports = frames["credit_reports"]
    turn = F.pmod(F.xxhash64("application_id", "report_date"), F.lit(7))
    frames["credit_reports"] = reports.withColumn("credit_report_id", F.when(turn == 0, "NONE").otherwise(F.col("credit_report_id")))
    return {n: df.limit(3000).cache() if n in {*moved} else df for n, df in frames.items()}


def test_crowded_keys_are_counted_without_pairs(lending):
    frames = _placeholder(lending)
    plain, forced = Tables(frames), Tables(frames, hot_min_rows=20)
    plain.crowded = lambda *names: []
    two_sided = [r for p in ALL_PACKS.values() for r in p if r.relation in SIDES]
    assert all((r.relation, r.predicate) in MEETINGS for r in two_sided)
    for sides in SIDES.values():
        assert forced.crowded(sides.left, sides.right, sides.key) == ["NONE"]
    want = {(r.rule_id, r.variant): (r.matching, r.base, r.status) for r in evaluate(two_sided, plain).collect()}
    got = {(r.rule_id, r.variant): (r.matching, r.base, r.status) for r in evaluate(two_sided, forced).collect()}
    assert want == got and max(m for m, _, _ in got.values()) > 100
    listed = ("INT-008", "POL-004", "LOG-008", "FND-018", "RUN-022", "FND-046")
    for rule in {r.id: r for r in two_sided if r.id in listed}.values():
        rows = {tuple(r) for r in offenders(rule, plain).collect()}
        assert rows == {tuple(r) for r in offenders(rule, forced).collect()}, rule.id
