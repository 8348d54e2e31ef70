"""Preparation operators on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanward.functions import dates, keyed
from loanward.functions.finance import installment, loan_amount, risk_rate
from loanward.plans.evaluate import evaluate
from loanward.plans.packs import FOUNDATION, RUNNER
from loanward.prepare import applications as pa
from loanward.prepare import completion as pc
from loanward.prepare import loans as pl
from loanward.sources.schemas import DeclaredColumn
from loanward.sources.tables import Tables

APPS = "application_id string, fico_score_at_application int, decision_status string, annual_income double, debt_to_income_ratio double, application_date date, decision_date date"


@pytest.fixture(scope="module")
def apps(spark):
    day = dt.date(2022, 1, 10)
    return spark.createDataFrame([
        (f"A-{i}", 600 + i, "approved" if i % 3 else "declined", 20000.0 + 1000 * i, 0.3, day, day) for i in range(200)], APPS)


def test_normalised_applications(apps):
    out = pa.normalise_applications(apps)
    assert {r[0] for r in out.select("decision_status").distinct().collect()} == {"APPROVED", "DECLINED"}
    assert {r[0] for r in out.select("channel").distinct().collect()} == {"ONLINE", "PARTNER", "DIRECT"}
    assert out.collect() == pa.normalise_applications(apps).collect()
    with pytest.raises(ValueError, match="decision_status"):
        pa.normalise_applications(apps.drop("decision_status"))


def test_take_rate_is_close_and_repeatable(apps):
    out = pa.funded_applications(pa.normalise_applications(apps), 90)
    assert 100 <= out.count() <= 133 and out.count() == pa.funded_applications(pa.normalise_applications(apps), 90).count()


def test_pricing(spark):
    row = spark.range(1).select(
        risk_rate(F.lit(750), F.lit(0.0)).alias("base"), risk_rate(F.lit(300), F.lit(1.0)).alias("high"),
        risk_rate(F.lit(700), F.lit(0.2), per_point=0.001).alias("steep"), loan_amount(F.lit(1000.0)).alias("low"),
        loan_amount(F.lit(1e9)).alias("top"), installment(F.lit(1200.0), F.lit(0.0), F.lit(12)).alias("flat"),
        installment(F.lit(10000.0), F.lit(0.12), F.lit(36)).alias("level"),
        risk_rate(F.lit(None).cast("int"), F.lit(0.1)).alias("unknown")).first()
    assert row.base == pytest.approx(0.15) and row.high == 0.25 and row.steep == pytest.approx(0.22)
    assert (row.low, row.top, row.flat, row.unknown) == (1000.0, 50000.0, 100.0, None)
    assert row.level == pytest.approx(332.1431, abs=1e-4)


def test_month_spine_and_book_months(spark):
    loans = spark.createDataFrame([("a", dt.date(2023, 11, 17)), ("b", dt.date(2024, 5, 1))], "loan_id string, origination_date date")
    rows = pl.month_spine(loans, dt.date(2024, 2, 10)).orderBy("snapshot_date").collect()
    assert [(r.loan_id, r.snapshot_date, r.months_on_book) for r in rows] == [
        ("a", dt.date(2023, 11, 30), 1), ("a", dt.date(2023, 12, 31), 1),
        ("a", dt.date(2024, 1, 31), 2), ("a", dt.date(2024, 2, 29), 3)]
    gap = spark.range(1).select(dates.months_apart(F.lit(dt.date(2024, 3, 1)), F.lit(dt.date(2024, 2, 29))).alias("m"))
    assert gap.first().m == 1


PANEL = ("loan_id string, snapshot_date date, months_on_book int, days_past_due int, current_principal_balance double, "
         "loan_status string, original_interest_rate double, original_installment_amount double, origination_date date, "
         "original_term_months int, original_loan_amount double, application_id string")


def _panel(spark, states, loan="a", balance=900.0):
    rows = [(loan, dt.date(2023, m, 28), m, 0, balance, s, 0.12, 50.0, dt.date(2022, 12, 1), 36, 1000.0, f"A{loan}")
            for m, s in enumerate(states, 1)]
    return spark.createDataFrame(rows, PANEL)


def test_rolls_give_missed_payments_that_satisfy_the_rule(spark):
    panel = _panel(spark, ["CURRENT", "DELINQUENT_30", "DELINQUENT_30", "DELINQUENT_60", "DELINQUENT_90", "CURRENT", "DELINQUENT_30"])
    missed = pl.missed_payments(panel)
    assert sorted(r.payment_id for r in missed.collect()) == [
        "PMT-a-2-MISSED", "PMT-a-4-MISSED60", "PMT-a-5-MISSED90", "PMT-a-7-MISSED"]
    assert [r.interest_accrued for r in missed.collect()] == [pytest.approx(9.0)] * 4
    paid = spark.createDataFrame([("P1", "a", "PAID")], "payment_id string, loan_id string, payment_status string")
    rule = [RUNNER.rule("RUN-011")]
    before = evaluate(rule, Tables({"loan_tape": panel, "payments": paid})).first()
    after = evaluate(rule, Tables({"loan_tape": panel, "payments": pl.backfill_missed(paid, panel)})).first()
    assert (before.violations, after.violations) == (5, 0)


def test_terminal_states_are_reported_once(spark):
    panel = _panel(spark, ["CURRENT", "PAID_OFF", "PAID_OFF", "PAID_OFF"])
    for hot in ((), ("a",)):
        kept = pl.terminal_once(panel, hot)
        assert kept.columns == panel.columns
        assert sorted(r.months_on_book for r in kept.collect()) == [1, 2]
    small = pl.natural_payoff(_panel(spark, ["CURRENT", "DELINQUENT_30"], balance=9.0)).collect()
    assert [(r.loan_status, r.current_principal_balance) for r in small] == [("PAID_OFF", 0.0), ("DELINQUENT_30", 9.0)]


def test_schedule_stops_at_chargeoff_and_runs_through_payoff(spark):
    as_of = dt.date(2023, 12, 31)
    co = pl.expected_schedule(_panel(spark, ["CURRENT", "CURRENT", "CHARGED_OFF"]), as_of)
    assert co.count() == 3 and {r.payment_type for r in co.collect()} == {"REGULAR"}
    po = pl.expected_schedule(_panel(spark, ["CURRENT"] * 4 + ["PAID_OFF"]), as_of).orderBy("payment_number").collect()
    assert [r.payment_type for r in po] == ["REGULAR"] * 4 + ["PAYOFF"]
    running = pl.expected_schedule(_panel(spark, ["CURRENT"]), as_of)
    assert running.count() == 12
    pre = pl.expected_schedule(_panel(spark, ["CURRENT", "PREPAID"]), as_of).collect()
    assert [(r.payment_type, r.scheduled_payment_amount) for r in pre] == [("PREPAYMENT", 1800.0)]


def test_waterfall_adds_up(spark):
    df = spark.createDataFrame([(100.0, 30.0, False), (20.0, 30.0, False), (0.0, 30.0, False), (100.0, 30.0, True)],
                               "paid double, accrued double, payoff boolean")
    got = df.select(*[c.alias(n) for n, c in pl.waterfall("paid", "accrued", F.col("payoff")).items()]).collect()
    assert [(r.interest_paid, r.principal_paid) for r in got] == [(30.0, 70.0), (20.0, 0.0), (0.0, 0.0), (0.0, 100.0)]


def test_interest_accrued_keeps_one_row_per_payment(spark):
    panel = _panel(spark, ["CURRENT"]).union(_panel(spark, ["CURRENT"]))
    paid = spark.createDataFrame([("p", "a", dt.date(2023, 1, 28)), ("q", "z", None)], "payment_id string, loan_id string, payment_due_date date")
    rows = pl.with_interest_accrued(pl.due_as_snapshot(paid), panel).orderBy("payment_id").collect()
    assert [r.interest_accrued for r in rows] == [pytest.approx(9.0), None]
    assert pl.with_interest_accrued(pl.due_as_snapshot(paid), panel, daily=30).filter("payment_id = 'p'").first().interest_accrued == 8.88


def test_status_and_vintage_columns(spark):
    got = spark.range(6).select(*[c.alias(n) for n, c in pl.status_columns(F.col("id")).items()]).collect()
    assert [(r.loan_status, r.days_past_due, r.chargeoff_flag, r.default_flag) for r in got] == [
        ("CURRENT", 0, 0, 0), ("DELINQUENT_30", 30, 0, 0), ("DELINQUENT_60", 60, 0, 0),
        ("DELINQUENT_90", 90, 0, 1), ("CHARGED_OFF", 120, 1, 1), ("PAID_OFF", 0, 0, 1)]
    day = spark.range(1).select(F.lit(dt.date(2023, 8, 5)).alias("origination_date"))
    row = day.select(*[c.alias(n) for n, c in pl.vintage_columns().items()]).first()
    assert tuple(row) == ("2023-08", "2023-Q3", 2023)


def test_completion_follows_names_and_keeps_data(spark):
    names = [("x_id", "VARCHAR"), ("account_id_count", "INT"), ("delinq_count", "INT"), ("inquiries_count", "INT"),
             ("open_trades_count", "INT"), ("trades_count", "INT"), ("other_count", "INT"), ("late_amount", "DECIMAL"),
             ("use_ratio", "DECIMAL"), ("update_note", "VARCHAR"), ("a_flag", "BOOLEAN"), ("match_flag", "VARCHAR"),
             ("word", "VARCHAR"), ("score", "INT"), ("kept_amount", "DECIMAL"), ("all_trades_count", "INT")]
    declared = [DeclaredColumn(*n) for n in names]
    df = spark.createDataFrame([(20, 7.0, None, 1)], "all_trades_count int, kept_amount double, word string, extra int")
    out = pc.hydrate(df, declared, F.lit(500))
    row = out.first().asDict()
    assert out.columns == [n for n, _ in names]
    assert row == {"x_id": None, "account_id_count": None, "delinq_count": 0, "inquiries_count": 1, "open_trades_count": 15,
                   "trades_count": 6, "other_count": 0, "late_amount": 0.0, "use_ratio": 0.0, "update_note": None,
                   "a_flag": False, "match_flag": "Y", "word": None, "score": 0, "kept_amount": 7.0, "all_trades_count": 20}
    assert pc.hydrate(df, []) is df
    share = pc.complete_schema(df, declared).first().open_trades_count
    assert 12 <= share <= 18


def test_fraud_and_verification(spark):
    df = spark.createDataFrame([("APPROVED", 399, 720), ("APPROVED", 400, 720), ("DECLINED", 100, 640), (None, 601, 640)],
                               "decision_status string, fraud_risk_score int, fico_score_at_application int")
    got = df.select(pa.fraud_check_status().alias("s"), pa.identity_score(F.lit(1000)).alias("i"),
                    pa.inquiry_count(F.lit(1)).alias("q")).collect()
    assert [r.s for r in got] == ["PASSED", "FLAGGED", "FLAGGED", "FAILED"]
    assert [70 <= r.i <= 95 for r in got] == [True, True, False, False]
    assert [r.q for r in got] == [2, 2, 6, 6]
    picks = spark.range(1000).select(keyed.weighted_choice(F.col("id"), pa.LOAN_TERMS).alias("t")).groupBy("t").count()
    assert {r.t: r["count"] for r in picks.collect()} == {24: 100, 36: 300, 48: 350, 60: 250}


def test_tradelines_of_prepared_reports_satisfy_the_rules(spark):
    reports = spark.createDataFrame([("A1", 700, 0.5, 10), ("A2", 640, 0.1, 12)],
                                    "application_id string, fico_score_8 int, revolving_utilization_ratio double, all_trades_count int")
    snap = pa.credit_snapshot(reports).withColumn("report_date", F.lit(dt.date(2022, 1, 1)))
    lines = pa.tradelines(snap)
    assert sorted(r.tradeline_id for r in lines.collect()) == ["CR-A1-TL1", "CR-A1-TL2", "CR-A2-TL2"]
    rules = [FOUNDATION.rule(f"FND-0{n}") for n in (44, 45, 46)] + [RUNNER.rule("RUN-051")]
    results = evaluate(rules, Tables({"credit_reports": snap, "credit_tradelines": lines})).collect()
    assert {r.matching for r in results} == {0}


def test_codes_and_delinquency_counts(spark, lending):
    codes = pa.reference_codes(lending["applications"])
    assert codes.groupBy("code_type", "code_value").count().filter("count > 1").isEmpty()
    panel = _panel(spark, ["DELINQUENT_30"]).withColumn("days_past_due", F.lit(65))
    reports = spark.createDataFrame([("Aa", 800), ("none", 600), ("none", 670), ("none", 730)], "application_id string, fico_score_8 int")
    got = pl.delinquency_counts(reports, panel).orderBy("fico_score_8").collect()
    assert [tuple(r)[2:] for r in got] == [(2, 0, 0), (1, 0, 0), (0, 0, 0), (1, 1, 0)]
