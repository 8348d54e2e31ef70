"""Lending tables derived from the star-schema test tables.

Each of the eight lending tables is a plain projection of one source table:
no join, no window, no shuffle, so a rule over a view costs what the rule
costs.  Columns are written in the SQL subset that Spark and DuckDB share, so
the oracle can evaluate the same view text in its own engine.

Keys, dates and amounts come from key arithmetic; faults are sprinkled in at
fixed key remainders so that every rule has something to find.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loanward.sources.tables import size_shuffles


def _orig(k: str) -> str:
    """Origination date of loan number ``k``: one of 48 cohorts, 30 days apart."""
    return f"(DATE '2020-01-01' + CAST(30 * (({k} * 17) % 48) AS INT))"


def _int(expr: str) -> str:
    return f"CAST({expr} AS INT)"


def _when(cond: str, value: str, otherwise: str = "0") -> str:
    return f"CASE WHEN {cond} THEN {value} ELSE {otherwise} END"


def _pick(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {index} {arms} ELSE '{values[-1]}' END"


@dataclass(frozen=True)
class View:
    """A projection: ``layers`` add helper columns, ``columns`` are the result."""

    source: str
    columns: dict[str, str]
    layers: list[dict[str, str]] = field(default_factory=list)
    where: str | None = None

    def frame(self, base: DataFrame) -> DataFrame:
        return base.sparkSession.sql(self.sql("{base}"), base=base)

    def sql(self, source: str | None = None) -> str:
        text = f"SELECT * FROM {source or self.source}" + (f" WHERE {self.where}" if self.where else "")
        for layer in self.layers:
            adds = ", ".join(f"{e} AS {n}" for n, e in layer.items())
            text = f"SELECT *, {adds} FROM ({text})"
        cols = ", ".join(f"{e} AS {n}" for n, e in self.columns.items())
        return f"SELECT {cols} FROM ({text})"


APPLICATIONS = View(
    source="orders",
    layers=[{
        "app_dt": f"({_orig('o_orderkey')} + "
                  + _int("-5 - o_orderkey % 11 + " + _when("o_orderkey % 23 = 0", "60")) + ")",
        "k": "o_orderkey",
    }],
    columns={
        "application_id": "'APP-' || CAST(k - " + _when("k % 997 = 5", "1") + " AS STRING)",
        "customer_id": "'CUST-' || CAST(k % 1511 AS STRING)",
        "application_date": "app_dt",
        "decision_date": "(app_dt + " + _int("k % 5") + ")",
        "application_timestamp": "CAST(app_dt AS TIMESTAMP)",
        "date_of_birth": "(app_dt + " + _int(
            _when("k % 211 = 0", "3", "-(6000 + (o_custkey * 17) % 25000)")) + ")",
        "decision_status": "CASE WHEN k % 101 = 0 THEN 'UNDER_REVIEW' WHEN k % 103 = 1 THEN 'INCOMPLETE' "
                           "WHEN o_orderstatus = 'P' AND k % 4 = 0 THEN 'PENDING' "
                           "WHEN o_orderstatus = 'O' AND k % 3 = 0 THEN 'DECLINED' ELSE 'APPROVED' END",
        "fico_score_at_application": _int("560 + (k * 37) % 300"),
        "debt_to_income_ratio": _when("k % 89 = 0", "NULL", "(k % 60) / 100.0E0"),
        "annual_income": "o_totalprice / 4.0E0 - " + _when("k % 401 = 0", "200000.0E0", "0.0E0"),
        "product_type": _when("k % 2 = 0", "'PERSONAL'", "'AUTO'"),
        "channel": _pick("k % 4", ["WEB", "MOBILE", "BRANCH", "PARTNER"]),
        "state": _pick("k % 12", ["CA", "NY", "TX", "FL", "WA", "IL", "GA", "OH", "MI", "NC", "ZZ", "AZ"]),
        "address_state": _pick("k % 12", ["CA", "NY", "TX", "FL", "WA", "IL", "GA", "OH", "MI", "NC", "ZZ", "AZ"]),
        "address_zip": "CASE WHEN k % 97 = 3 THEN NULL WHEN k % 71 = 0 THEN '123' "
                       "ELSE lpad(CAST(k % 100000 AS STRING), 5, '0') END",
        "ssn_last4": "CASE WHEN k % 83 = 0 THEN '12a4' WHEN k % 84 = 1 THEN '123' "
                     "ELSE lpad(CAST((k * 7) % 10000 AS STRING), 4, '0') END",
        "ssn_hash": "CASE WHEN k % 9 = 0 THEN NULL ELSE 'H' || CAST(k AS STRING) END",
        "email_address": "CASE WHEN k % 50 = 0 THEN 'user' || CAST(k AS STRING) || 'example.com' "
                         "WHEN k % 51 = 1 THEN NULL WHEN k % 52 = 2 THEN 'user@localhost' "
                         "ELSE 'user' || CAST(k AS STRING) || '@mail' || CAST(k % 7 AS STRING) || '.com' END",
        "phone_primary": "CASE WHEN k % 45 = 0 THEN '5551234' WHEN k % 46 = 1 THEN NULL "
                         "WHEN k % 47 = 2 THEN '(212) 555-0100' "
                         "ELSE lpad(CAST(k % 1000 AS STRING), 3, '2') || '-555-' || "
                         "lpad(CAST(k % 10000 AS STRING), 4, '0') END",
    },
)

LOAN_TAPE = View(
    source="lineitem",
    layers=[
        {
            "k": "l_orderkey", "n": "l_linenumber", "p": "l_partkey",
            "orig_dt": _orig("l_orderkey"),
            "term": _int(_when("l_orderkey % 397 = 0", "480", "12 * (1 + l_orderkey % 6)")),
            "amt": _when("l_orderkey % 499 = 0", "0.0E0", "1000.0E0 + ((l_orderkey * 37) % 1050) * 100.0E0"),
            "rate": "((l_orderkey * 7) % 45) / 100.0E0",
            "status": "CASE WHEN l_quantity > 40 AND l_returnflag = 'R' THEN 'CHARGED_OFF' "
                      "WHEN l_quantity > 40 AND l_returnflag = 'A' THEN 'PAID_OFF' "
                      "WHEN l_quantity > 38 THEN 'DELINQUENT_120' WHEN l_quantity > 35 THEN 'DELINQUENT_90' "
                      "WHEN l_quantity > 30 THEN 'DELINQUENT_60' WHEN l_quantity > 25 THEN 'DELINQUENT_30' "
                      "WHEN l_quantity = 1 THEN 'CANCELLED' WHEN l_quantity = 2 THEN 'PREPAID' "
                      "WHEN l_quantity = 3 THEN 'FROZEN' ELSE 'CURRENT' END",
            "dpd": _int("CASE WHEN l_quantity > 25 AND l_partkey % 19 = 0 THEN 3 * l_quantity - 20 "
                        "WHEN l_quantity > 25 THEN 3 * l_quantity WHEN l_linenumber = 7 THEN 5 ELSE 0 END"),
        },
        {
            "first_due": "(orig_dt + " + _int("10 - " + _when("k % 29 = 0", "15")) + ")",
            "bal": "CASE WHEN status = 'PAID_OFF' AND p % 3 <> 0 THEN 0.0E0 WHEN p % 301 = 0 THEN -5.0E0 "
                   "ELSE l_extendedprice END",
            "int_bal": "l_tax * 100.0E0 - " + _when("p % 203 = 0", "50.0E0", "0.0E0"),
            "fee_bal": "l_discount * 50.0E0",
            "fee": "amt * (0.03E0 + " + _when("k % 59 = 0", "0.05E0", "0.0E0") + " + "
                   + _when("k % 509 = 0", "1.0E0", "0.0E0") + ")",
            "grade_": "substr('ABCDE', " + _int("1 + k % 5") + ", 1)",
        },
    ],
    columns={
        "loan_id": "'LN-' || CAST(k AS STRING)",
        "application_id": "CASE WHEN k % 613 = 7 THEN 'APP-X' ELSE 'APP-' END || CAST(k AS STRING)",
        "customer_id": "CASE WHEN p % 200 = 0 THEN 'CUST-X' ELSE 'CUST-' || CAST(k % 1511 AS STRING) END",
        "snapshot_date": "(orig_dt + " + _int("31 * n - p % 3") + ")",
        "origination_date": "orig_dt",
        "first_payment_due_date": "first_due",
        "note_signature_date": "(orig_dt + " + _int("-2 + " + _when("k % 31 = 0", "5")) + ")",
        "maturity_date": "(first_due + " + _int(
            "((term - 1) * 3044 - ((term - 1) * 3044) % 100) / 100 + " + _when("k % 37 = 0", "20")) + ")",
        "loan_status": "status",
        "grade": "grade_",
        "subgrade": _when("k % 47 = 0", "'F1'", "grade_ || CAST(1 + k % 3 AS STRING)"),
        "vintage_month": "CASE WHEN k % 333 = 0 THEN NULL WHEN k % 41 = 0 THEN '2019-12' "
                         "ELSE substr(CAST(orig_dt AS STRING), 1, 7) END",
        "vintage_year": _int("year(orig_dt) + " + _when("k % 43 = 0", "1")),
        "loan_payment_history": _pick("p % 4", ["000000", "000100", "010203", ""]),
        "months_on_book": _int(_when("n = 7 AND l_suppkey % 3 = 0", "1", "n") + " + " + _when("l_suppkey % 20 = 0", "1")
                               + " + " + _when("p % 307 = 0", "100")),
        "days_past_due": "dpd",
        "worst_days_past_due": _int("dpd + 10 - " + _when("p % 17 = 0", "20")),
        "original_term_months": "term",
        "times_30_dpd": _int("CASE p % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END"),
        "times_60_dpd": _int("p % 3"),
        "times_90_dpd": _int("p % 2"),
        "times_120_dpd": _int(_when("p % 5 = 0", "1")),
        "months_since_last_delinquency": _int(
            "CASE p % 6 WHEN 0 THEN NULL WHEN 1 THEN 999 WHEN 2 THEN 0 ELSE p % 24 END"),
        "current_principal_balance": "bal",
        "current_interest_balance": "int_bal",
        "current_fees_balance": "fee_bal",
        "payoff_amount": _when("p % 7 = 0", "0.0E0", "bal + int_bal + fee_bal + "
                               + _when("p % 13 = 0", "25.0E0", "0.0E0")),
        "disbursed_amount": "amt - fee + " + _when("k % 14 = 0", "30.0E0", "0.0E0"),
        "original_loan_amount": "amt",
        "original_interest_rate": "rate",
        "original_apr": "rate + 0.01E0 + " + _when("k % 19 = 0", "0.06E0", "0.0E0")
                        + " - " + _when("k % 53 = 0", "0.02E0", "0.0E0"),
        "original_installment_amount":
            "CASE WHEN k % 503 = 0 THEN 0.0E0 WHEN rate = 0 THEN amt / term ELSE "
            "amt * (rate / 12) * pow(1 + rate / 12, term) / (pow(1 + rate / 12, term) - 1) END + "
            + _when("k % 10 = 0", "5.0E0", "0.0E0"),
        "origination_fee": "fee",
        "chargeoff_flag": _int(_when("status = 'CHARGED_OFF'", "1")),
        "default_flag": _int(_when("l_quantity > 35", "1")),
        "delinquent_flag": _when("p % 61 = 0", "dpd = 0", "dpd > 0"),
        "interest_only_indicator": "k % 15 = 0",
        "never_paid_flag": "k % 8 = 3",
        "delinquent_0_30_flag": "dpd BETWEEN 1 AND 30 OR p % 67 = 0",
        "delinquent_31_60_flag": "dpd BETWEEN 31 AND 60",
        "delinquent_61_90_flag": "dpd BETWEEN 61 AND 91",
        "delinquent_91_120_flag": "dpd BETWEEN 91 AND 120",
    },
)

PAYMENTS = View(
    source="events",
    layers=[
        {
            "e": "event_id", "ln": "event_id - event_id % 4 + 3",
            "orig_dt": _orig("(event_id - event_id % 4 + 3)"),
            "st": "CASE event_type WHEN 'error' THEN 'MISSED' WHEN 'click' THEN 'PARTIAL' "
                  "WHEN 'view' THEN 'POSTED' WHEN 'purchase' THEN 'PAID' ELSE "
                  "CASE event_id % 3 WHEN 0 THEN 'REVERSED' WHEN 1 THEN 'RETURNED' ELSE 'PENDING' END END",
        },
        {
            "due": "(orig_dt + " + _int("10 + 31 * (e % 4) - " + _when("e % 71 = 0", "140")) + ")",
            "paid": "CASE WHEN st = 'MISSED' AND e % 6 <> 0 THEN 0.0E0 WHEN e % 401 = 0 THEN -1.0E0 * value "
                    "ELSE value END",
            "sched": _when("e % 43 = 0", "0.0E0", "value * (0.9E0 + (e % 5) * 0.05E0)"),
            "returned": "(e % 140 = 0 OR e % 80 = 0)",
            "begin_bal": "1000.0E0 + value * 10.0E0",
        },
    ],
    columns={
        "payment_id": "'PMT-' || CAST(e AS STRING)",
        "loan_id": "CASE WHEN e % 307 = 0 THEN NULL WHEN e % 61 = 0 THEN 'LN-X' || CAST(e AS STRING) "
                   "ELSE 'LN-' || CAST(ln AS STRING) END",
        "customer_id": "CASE WHEN e % 90 = 0 THEN 'CUST-Y' ELSE 'CUST-' || CAST(ln % 1511 AS STRING) END",
        "payment_due_date": "due",
        "payment_received_date": "CASE WHEN e % 17 = 0 THEN NULL ELSE (due + " + _int(
            _when("e % 33 = 0", "-45", "e % 13 - 6")) + ") END",
        "snapshot_date": "(orig_dt + " + _int("31 * (1 + e % 4)") + ")",
        "return_date": "CASE WHEN returned AND e % 160 <> 0 THEN (due + 5) ELSE NULL END",
        "payment_status": "st",
        "payment_type": "CASE WHEN e % 20 = 0 THEN NULL WHEN e % 10 = 1 THEN 'PREPAYMENT' "
                        "WHEN e % 10 = 2 THEN 'PAYOFF' ELSE 'REGULAR' END",
        "payment_method": _when("e % 3 = 0", "'CARD'", "'ACH'"),
        "payment_channel": _pick("e % 5", ["WEB", "MOBILE", "PHONE", "AUTOPAY", "WEB"]),
        "return_reason_code": "CASE WHEN e % 3 = 0 THEN NULL ELSE 'R01' END",
        "scheduled_payment_amount": "sched",
        "scheduled_payment_amount_calc": "sched",
        "actual_payment_amount": "paid",
        "principal_paid": "paid * 0.8E0",
        "interest_paid": "paid * 0.2E0 + " + _when("e % 50 = 0", "0.5E0", "0.0E0"),
        "interest_accrued": "value * 0.2E0 + (e % 9 - 4) * 0.1E0",
        "beginning_principal_balance": "begin_bal",
        "ending_principal_balance": "begin_bal - paid * 0.8E0 + " + _when("e % 21 = 0", "1.0E0", "0.0E0"),
        "fees_paid": _when("e % 31 = 0", "1.0E0", "0.0E0"),
        "late_fee_paid": _when("e % 62 = 0", "15.0E0", "0.0E0"),
        "late_fee_assessed": _when("e % 3 = 0", "15.0E0", "0.0E0"),
        "suspense_amount": _when("e % 25 = 0", "1.5E0", "0.0E0"),
        "unapplied_amount": _when("e % 27 = 0", "2.0E0", "0.0E0"),
        "days_late": _int("e % 40"),
        "grace_period_days": _int("CASE WHEN e % 2 = 0 THEN NULL ELSE 10 END"),
        "nsf_flag": "e % 70 = 0",
        "returned_flag": "returned",
        "autopay_flag": "e % 10 < 7",
        "late_fee_waived": "e % 4 = 1",
        "is_extra_payment": "e % 11 = 0",
    },
)

CREDIT_REPORTS = View(
    source="orders",
    where="o_orderkey % 50 <> 7",
    layers=[{"k": "o_orderkey", "orig_dt": _orig("o_orderkey")}],
    columns={
        "credit_report_id": "'CR-' || CAST(k AS STRING)",
        "application_id": "CASE WHEN k % 701 = 3 THEN 'APP-X' ELSE 'APP-' END || CAST(k AS STRING)",
        "report_date": "(orig_dt + " + _int("-5 - k % 11 + k % 7 - " + _when("k % 27 = 0", "50")) + ")",
        "file_since_date": _when("k % 73 = 0", "DATE '1930-01-01'",
                                 "(orig_dt - " + _int("1000 + (k * 31) % 9000") + ")"),
        "fico_score_8": _int("560 + (k * 37) % 300 + " + _when("k % 30 = 0", "35")),
        "vantage_score_3": _int("300 + (k * 41) % 560"),
        "all_trades_count": _int("5 + k % 20"),
        "all_trades_open_count": _int("k % 12"),
        "open_trades_count": _int("k % 13 - " + _when("k % 211 = 0", "14")),
        "bankcard_trades_count": _int("k % 8"),
        "bankcard_trades_open_count": _int("k % 9"),
        "revolving_trades_count": _int("k % 9"),
        "revolving_trades_open_count": _int("k % 10"),
        "installment_trades_count": _int("k % 6"),
        "installment_trades_open_count": _int("k % 5"),
        "mortgage_trades_count": _int("k % 3"),
        "trades_currently_past_due_count": _int("k % 7"),
        "inquiries_6mo_count": _int("k % 9"),
        "inquiries_last_6mo_count": _int("k % 9 - " + _when("k % 223 = 0", "10")),
        "public_records_count": _int(_when("k % 40 = 0", "1")),
        "bankruptcies_count": _int(_when("k % 35 = 0", "1")),
        "delinquency_30_day_count": _int("k % 4"),
        "months_since_oldest_trade": _int("k % 300 - " + _when("k % 307 = 0", "400")),
        "revolving_utilization_ratio": "((k * 13) % 260) / 100.0E0 - " + _when("k % 311 = 0", "3.0E0", "0.0E0"),
        "bureau_code": _pick("k % 3", ["TU", "EFX", "EXP"]),
    },
)

CREDIT_TRADELINES = View(
    source="lineitem",
    layers=[{"k": "l_orderkey", "p": "l_partkey", "orig_dt": _orig("l_orderkey")}],
    columns={
        "tradeline_id": "'TL-' || CAST(k AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || "
                        "CAST(p AS STRING) || '-' || CAST(l_suppkey AS STRING)",
        "credit_report_id": "'CR-' || CAST(k AS STRING)",
        "account_type": "CASE l_returnflag WHEN 'R' THEN 'MORTGAGE' WHEN 'A' THEN 'REVOLVING' ELSE 'INSTALLMENT' END",
        "account_status": _when("l_linestatus = 'O'", "'OPEN'", "'CLOSED'"),
        "current_balance": "l_extendedprice",
        "credit_limit": "l_extendedprice * (0.8E0 + l_tax * 5.0E0)",
        "monthly_payment": _when("l_linestatus <> 'O' AND p % 5 <> 0", "0.0E0", "25.0E0"),
        "open_date": "(orig_dt - " + _int("(p * 13) % 20000 - " + _when("p % 40 = 0", "15")) + ")",
        "times_30dpd": _int(_when("p % 10 < 3", "p % 3")),
        "times_60dpd": _int(_when("p % 20 = 2", "1")),
        "times_90dpd": _int(_when("p % 40 = 2", "1")),
    },
)

FRAUD_VERIFICATION = View(
    source="orders",
    where="o_orderkey % 40 <> 3",
    layers=[{"k": "o_orderkey", "orig_dt": _orig("o_orderkey")}],
    columns={
        "application_id": "CASE WHEN k % 809 = 9 THEN 'APP-X' ELSE 'APP-' END || CAST(k - "
                          + _when("k % 600 = 1", "1") + " AS STRING)",
        "fraud_check_timestamp": "CAST((orig_dt + " + _int(
            "-5 - k % 11 + k % 3 - " + _when("k % 44 = 0", "4")) + ") AS TIMESTAMP)",
        "fraud_check_status": "CASE k % 12 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'FLAGGED' ELSE 'PASSED' END",
        "fraud_risk_score": _int("(k * 11) % 1010"),
        "income_verification_status": "CASE WHEN k % 14 = 0 THEN NULL ELSE 'VERIFIED' END",
        "employment_verification_status": "CASE WHEN k % 16 = 0 THEN NULL ELSE 'VERIFIED' END",
        "identity_verification_score": _int("k % 103"),
        "synthetic_identity_score": _int("k % 101"),
        "overall_fraud_score": _int("600 + k % 300"),
        "identity_verification_result": _when("k % 33 = 0", "'FAIL'", "'PASS'"),
        "fraud_risk_tier": "CASE WHEN k % 29 = 0 THEN 'CRITICAL' WHEN k % 7 = 0 THEN 'MEDIUM' ELSE 'LOW' END",
        "ssn_deceased_flag": "k % 111 = 0",
        "address_verified": "k % 5 <> 0",
        "ssn_issued_start_year": _int("1940 + k % 70"),
    },
)

BANK_TRANSACTIONS = View(
    source="events",
    layers=[{"e": "event_id"}],
    columns={
        "transaction_id": "'TXN-' || CAST(e AS STRING)",
        "application_id": "CASE WHEN e % 97 = 0 THEN 'APP-X' ELSE 'APP-' END || CAST(e AS STRING)",
        "bank_acct_id": "'BA-' || CAST(user_id AS STRING)",
        "transaction_date": "ts",
        "amount": "value - 100.0E0",
        "type": _when("value < 100", "'DEBIT'", "'CREDIT'"),
        "category": "event_type",
        "merchant": "'M-' || CAST(e % 40 AS STRING)",
        "description": "'M-' || CAST(e % 40 AS STRING) || ' ' || event_type",
    },
)

VIEWS: dict[str, View] = {
    "applications": APPLICATIONS,
    "loan_tape": LOAN_TAPE,
    "payments": PAYMENTS,
    "credit_reports": CREDIT_REPORTS,
    "credit_tradelines": CREDIT_TRADELINES,
    "fraud_verification": FRAUD_VERIFICATION,
    "bank_transactions": BANK_TRANSACTIONS,
}


def lending_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The lending tables as lazy projections of the Parquet tables in ``sf_dir``."""
    base: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    for name, view in VIEWS.items():
        if view.source not in base:
            base[view.source] = spark.read.parquet(os.path.join(sf_dir, f"{view.source}.parquet"))
        out[name] = view.frame(base[view.source])
    size_shuffles(base.values())
    return out
