"""Preparation operators applied to whole tables, as named queries.

Choices that depend on a row key use key arithmetic here instead of the hash, so that
another engine can repeat them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanward.functions import dates
from loanward.functions.finance import clip, installment, loan_amount, risk_rate
from loanward.operators.skew import skew_join
from loanward.prepare import applications as pa
from loanward.prepare import completion as pc
from loanward.prepare import loans as pl
from loanward.sources.schemas import DeclaredColumn
from loanward.sources.tables import Tables

PREPARATIONS: dict[str, Callable[[Tables], DataFrame]] = {}


def preparation(name: str):
    def register(build):
        PREPARATIONS[name] = build
        return build
    return register


def key_number(column: str) -> Column:
    """The digits at the end of a key."""
    return F.regexp_extract(column, "([0-9]+)$", 1).cast("long")


def _app() -> Column:
    return key_number("application_id")


def _funded(t: Tables) -> DataFrame:
    return pa.funded_applications(t["applications"], 90, _app())


@preparation("pr_01_normalise_applications")
def pr01(t: Tables) -> DataFrame:
    raw = t["applications"].drop("channel").withColumn("decision_status", F.lower("decision_status"))
    return pa.normalise_applications(raw, _app()).select("application_id", "decision_status", "channel", "product_type")


@preparation("pr_02_funded_population")
def pr02(t: Tables) -> DataFrame:
    return _funded(t).select("application_id", "customer_id")


@preparation("pr_03_risk_rate")
def pr03(t: Tables) -> DataFrame:
    return _funded(t).select("application_id", F.round(risk_rate(
        "fico_score_at_application", "debt_to_income_ratio"), 8).alias("rate"), F.round(risk_rate(
            "fico_score_at_application", "debt_to_income_ratio", per_point=0.001), 8).alias("steep_rate"))


@preparation("pr_04_loan_amount")
def pr04(t: Tables) -> DataFrame:
    return _funded(t).select("application_id", loan_amount("annual_income").alias("amount"),
                             clip("annual_income", 20000.0, 90000.0).alias("income_capped"))


@preparation("pr_05_installment")
def pr05(t: Tables) -> DataFrame:
    loans = pa.priced_loans(_funded(t), pa.loan_term(_app()))
    return loans.select("application_id", "original_term_months",
                        F.round("original_installment_amount", 6).alias("installment"),
                        installment("original_loan_amount", F.lit(0.0), "original_term_months").alias("straight_line"))


def _loans(t: Tables) -> DataFrame:
    """One row per loan; attributes repeat over its snapshots."""
    return t["loan_tape"].groupBy("loan_id").agg(
        F.min("origination_date").alias("origination_date"),
        F.max("original_installment_amount").alias("projected_amount"))


@preparation("pr_06_month_spine")
def pr06(t: Tables) -> DataFrame:
    spine = pl.month_spine(_loans(t), t.as_of)
    return spine.groupBy("loan_id").agg(
        F.count(F.lit(1)).alias("months"), F.min("snapshot_date").cast("string").alias("first_month"),
        F.max("snapshot_date").cast("string").alias("last_month"))


@preparation("pr_07_months_on_book")
def pr07(t: Tables) -> DataFrame:
    on_book = dates.months_on_book("snapshot_date", "origination_date")
    return t["loan_tape"].groupBy("loan_id").agg(
        F.sum(on_book).alias("on_book"),
        F.sum(dates.months_apart("snapshot_date", "origination_date")).alias("apart"))


@preparation("pr_08_expected_schedule")
def pr08(t: Tables) -> DataFrame:
    due = pl.expected_schedule(t["loan_tape"], t.as_of)
    return due.groupBy("loan_id", "payment_type").agg(
        F.count(F.lit(1)).alias("payments"), F.min("payment_due_date").cast("string").alias("first_due"),
        F.max("payment_due_date").cast("string").alias("last_due"),
        F.round(F.sum("scheduled_payment_amount"), 2).alias("scheduled"))


@preparation("pr_09_missed_payments")
def pr09(t: Tables) -> DataFrame:
    missed = pl.missed_payments(t["loan_tape"], t.hot("loan_tape", "loan_id"))
    return missed.select("payment_id", "loan_id", F.col("payment_due_date").cast("string").alias("payment_due_date"),
                         "payment_status", "actual_payment_amount", "interest_accrued")


@preparation("pr_09_backfilled_payments")
def pr09b(t: Tables) -> DataFrame:
    filled = pl.backfill_missed(t["payments"], t["loan_tape"], t.hot("loan_tape", "loan_id"))
    return filled.groupBy("payment_status").agg(F.count(F.lit(1)).alias("payments"))


@preparation("pr_10_payment_waterfall")
def pr10(t: Tables) -> DataFrame:
    split = pl.waterfall("actual_payment_amount", "interest_accrued", F.col("payment_type") == "PAYOFF")
    return t["payments"].select("payment_id", *[F.round(c, 6).alias(n) for n, c in split.items()])


@preparation("pr_11_interest_accrued")
def pr11(t: Tables) -> DataFrame:
    hot = t.hot("payments", "loan_id")
    paid = pl.due_as_snapshot(t["payments"].drop("interest_accrued").withColumn(
        "payment_due_date", F.col("snapshot_date")))
    monthly = pl.with_interest_accrued(paid, t["loan_tape"], hot)
    return monthly.select("payment_id", F.round("interest_accrued", 6).alias("interest_accrued"))


@preparation("pr_11_interest_daily")
def pr11b(t: Tables) -> DataFrame:
    paid = t["payments"].drop("interest_accrued")
    daily = pl.with_interest_accrued(paid, t["loan_tape"], t.hot("payments", "loan_id"), daily=30)
    return daily.filter("interest_accrued IS NOT NULL").select(
        "payment_id", F.round("interest_accrued", 1).alias("interest_accrued"))


@preparation("pr_12_status_columns")
def pr12(t: Tables) -> DataFrame:
    coded = t["loan_tape"].withColumn("state_code", F.pmod(key_number("loan_id"), F.lit(6)))
    labelled = coded.select("loan_id", *[c.alias(n) for n, c in pl.status_columns("state_code").items()])
    return labelled.groupBy("loan_status", "days_past_due", "chargeoff_flag", "default_flag").agg(
        F.count(F.lit(1)).alias("row_count"))


@preparation("pr_13_vintage_columns")
def pr13(t: Tables) -> DataFrame:
    keyed = t["loan_tape"].select(*[c.alias(n) for n, c in pl.vintage_columns().items()])
    return keyed.groupBy("vintage_month", "vintage_quarter", "vintage_year").agg(F.count(F.lit(1)).alias("row_count"))


@preparation("pr_14_terminal_once")
def pr14(t: Tables) -> DataFrame:
    kept = pl.terminal_once(t["loan_tape"], t.hot("loan_tape", "loan_id"))
    return kept.groupBy("loan_id").agg(F.count(F.lit(1)).alias("snapshots"))


@preparation("pr_15_natural_payoff")
def pr15(t: Tables) -> DataFrame:
    panel = pl.natural_payoff(t["loan_tape"], below=2000.0)
    return panel.groupBy("loan_status").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("current_principal_balance"), 2).alias("balance"))


@preparation("pr_16_projected_balances")
def pr16(t: Tables) -> DataFrame:
    projected = pl.projected_balances(pl.month_spine(_loans(t), t.as_of), "projected_amount")
    return projected.groupBy("loan_id").agg(
        F.round(F.min("current_principal_balance"), 6).alias("lowest_balance"),
        F.round(F.max("current_principal_balance"), 6).alias("highest_balance"))


@preparation("pr_17_credit_snapshot")
def pr17(t: Tables) -> DataFrame:
    return pa.credit_snapshot(t["credit_reports"].drop("credit_report_id")).select(
        "credit_report_id", "vantage_score_3", "revolving_trades_count")


@preparation("pr_18_tradelines")
def pr18(t: Tables) -> DataFrame:
    lines = pa.tradelines(t["credit_reports"])
    return lines.select("tradeline_id", "account_type", F.round("current_balance", 4).alias("current_balance"),
                        F.round("credit_limit", 4).alias("credit_limit"),
                        F.round("monthly_payment", 4).alias("monthly_payment"),
                        F.col("open_date").cast("string").alias("open_date"))


@preparation("pr_19_identity_score")
def pr19(t: Tables) -> DataFrame:
    return t["applications"].select("application_id", pa.identity_score(_app()).alias("score"))


@preparation("pr_20_fraud_check_status")
def pr20(t: Tables) -> DataFrame:
    checks = t["fraud_verification"].select("application_id", "fraud_risk_score")
    decided = skew_join(checks, t["applications"].select("application_id", "decision_status"), "application_id",
                        "inner", t.hot("fraud_verification", "application_id"))
    return decided.select("application_id", "fraud_risk_score", pa.fraud_check_status().alias("fraud_check_status"))


@preparation("pr_21_weighted_columns")
def pr21(t: Tables) -> DataFrame:
    out = pa.verification_columns(t["applications"], _app())
    return out.select("application_id", "income_verification_status", "employment_verification_status",
                      pa.inquiry_count(_app()).alias("inquiries"), pa.loan_term(_app()).alias("term"))


@preparation("pr_22_funding_date")
def pr22(t: Tables) -> DataFrame:
    return t["applications"].filter("decision_status = 'APPROVED'").select(
        "application_id", pa.funding_date("decision_date", _app()).cast("string").alias("funding_date"))


#: A declared schema for the completion query.
DECLARED_REPORT = tuple(DeclaredColumn(n, k) for n, k in (
    ("credit_report_id", "VARCHAR"), ("application_id", "VARCHAR"), ("fico_score_8", "INT"),
    ("all_trades_count", "INT"), ("open_trades_count", "INT"), ("mortgage_trades_count", "INT"),
    ("delinquency_30_day_count", "INT"), ("inquiries_6mo_count", "INT"), ("collections_count", "INT"),
    ("total_balance_amount", "DECIMAL"), ("revolving_utilization_ratio", "DECIMAL"), ("update_date", "DATE"),
    ("freeze_flag", "BOOLEAN"), ("name_match_flag", "VARCHAR"), ("bureau_name", "VARCHAR"), ("segment", "INT"),
    ("external_id", "VARCHAR"), ("bureau_code", "VARCHAR"),
))


@preparation("pr_23_complete_schema")
def pr23(t: Tables) -> DataFrame:
    """Reports stripped of some columns and with an empty one, completed and projected."""
    bare = t["credit_reports"].select("credit_report_id", "application_id", "fico_score_8", "all_trades_count",
                                      "revolving_utilization_ratio", "vantage_score_3").withColumn(
        "bureau_code", F.lit(None).cast("string"))
    return pc.hydrate(bare, DECLARED_REPORT, key_number("credit_report_id"))


@preparation("pr_24_project_schema")
def pr24(t: Tables) -> DataFrame:
    return pc.project_schema(t["credit_reports"], DECLARED_REPORT)


@preparation("pr_25_reference_codes")
def pr25(t: Tables) -> DataFrame:
    return pa.reference_codes(t["applications"])


@preparation("pr_26_constants_and_names")
def pr26(t: Tables) -> DataFrame:
    lines = pc.add_constants(t["credit_tradelines"], months_reviewed=12)
    return pc.rename(lines, {"account_type": "kind", "not_there": "unused"}).groupBy(
        "kind", "account_status", "months_reviewed").agg(F.count(F.lit(1)).alias("row_count"))


@preparation("pr_27_delinquency_counts")
def pr27(t: Tables) -> DataFrame:
    out = pl.delinquency_counts(t["credit_reports"], t["loan_tape"], t.hot("credit_reports", "application_id"))
    return out.select("credit_report_id", *[f"delinquency_{d}_day_count" for d in (30, 60, 90)])
