"""How rules on two-sided joins are counted where a key is frequent on both sides.

A rule's predicate tests single pairs. For a key such as a placeholder id, which both tables repeat with different rows,
the same rule is a set of meetings, counted from order alone. SIDES says what a relation joins; MEETINGS says what a
predicate asks of either side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from loanward.operators.pairs import Meeting


@dataclass(frozen=True)
class Sides:
    """The joined tables, their key, and what the join takes of the left one."""

    left: str
    right: str
    key: str
    rows: Callable[[DataFrame], DataFrame] = lambda df: df


SIDES: dict[str, Sides] = {
    "loan_application": Sides("loan_tape", "applications", "application_id"),
    "report_application": Sides("credit_reports", "applications", "application_id"),
    "fraud_application": Sides("fraud_verification", "applications", "application_id"),
    "tradeline_report": Sides("credit_tradelines", "credit_reports", "credit_report_id"),
    "origination_decision": Sides("loan_tape", "applications", "application_id",
                                  lambda df: df.select("application_id", "loan_id", "origination_date").distinct()),
}

#: Every pair: the base of rates on a relation.
ALL = (Meeting(),)


def _right(*conditions: str) -> dict[str, tuple[Meeting, ...]]:
    """Rules that ask a condition of the application alone."""
    return {f"app_{c}": (Meeting(right_where=c),) for c in conditions}


def _both(order: str, left: str, right: str = "decision_status = 'APPROVED'") -> tuple[str, tuple[Meeting, ...]]:
    return order.format(left=left, right=f"app_{right}"), (Meeting(left, right),)


_MEETINGS: dict[str, dict[str, tuple[Meeting, ...]]] = {
    "loan_application": {
        **_right("decision_status <> 'APPROVED'", "decision_status = 'DECLINED'",
                 "decision_status IN ('PENDING', 'UNDER_REVIEW', 'INCOMPLETE')", "decision_status IN ('PENDING', 'UNDER_REVIEW')"),
        "origination_date < app_application_date": (Meeting(left="origination_date", op="<", right="application_date"),),
        "customer_id <> app_customer_id": (Meeting(left="customer_id", op="<>", right="customer_id"),),
        "(app_product_type = 'PERSONAL' AND (original_loan_amount < 1000 OR original_loan_amount > 50000)) OR "
        "(app_product_type = 'AUTO' AND (original_loan_amount < 5000 OR original_loan_amount > 100000))": (
            Meeting("original_loan_amount < 1000 OR original_loan_amount > 50000", "product_type = 'PERSONAL'"),
            Meeting("original_loan_amount < 5000 OR original_loan_amount > 100000", "product_type = 'AUTO'")),
        "app_product_type = 'PERSONAL' AND original_term_months NOT IN (12, 24, 36, 48, 60)": (
            Meeting("original_term_months NOT IN (12, 24, 36, 48, 60)", "product_type = 'PERSONAL'"),),
        "original_loan_amount > 25000 AND app_annual_income < 40000 AND app_decision_status = 'APPROVED'": (
            Meeting("original_loan_amount > 25000", "annual_income < 40000 AND decision_status = 'APPROVED'"),),
    },
    "report_application": {
        "report_date < app_application_date": (Meeting(left="report_date", op="<", right="application_date"),),
        "file_since_date < app_date_of_birth": (Meeting(left="file_since_date", op="<", right="date_of_birth"),),
        "abs(datediff(app_application_date, report_date)) > 30": (
            Meeting(left="to_date(report_date)", op="<", right="date_sub(application_date, 30)"),
            Meeting(left="to_date(report_date)", op=">", right="date_add(application_date, 30)")),
        "abs(app_fico_score_at_application - fico_score_8) > 20": (
            Meeting(left="fico_score_8", op="<", right="fico_score_at_application - 20"),
            Meeting(left="fico_score_8", op=">", right="fico_score_at_application + 20")),
    },
    "fraud_application": {
        "to_date(fraud_check_timestamp) < app_application_date": (
            Meeting(left="to_date(fraud_check_timestamp)", op="<", right="application_date"),),
        "fraud_check_timestamp < app_application_timestamp": (
            Meeting(left="fraud_check_timestamp", op="<", right="application_timestamp"),),
        "ssn_issued_start_year < year(app_date_of_birth)": (
            Meeting(left="ssn_issued_start_year", op="<", right="year(date_of_birth)"),),
        "address_verified = FALSE": (Meeting("address_verified = FALSE"),),
        **dict(_both("{left} AND {right}", c) for c in (
            "ssn_deceased_flag = TRUE", "identity_verification_result = 'FAIL'", "fraud_risk_tier = 'CRITICAL'")),
        **dict(_both("{right} AND {left}", c) for c in (
            "fraud_check_status = 'FAILED'", "income_verification_status IS NULL", "employment_verification_status IS NULL")),
    },
    "origination_decision": {
        "app_decision_date > origination_date": (Meeting(left="origination_date", op="<", right="decision_date"),),
    },
    "tradeline_report": {
        "open_date > rep_report_date": (Meeting(left="open_date", op=">", right="report_date"),),
    },
}
#: What a relation's predicate asks of its sides.
MEETINGS: dict[tuple[str, str], tuple[Meeting, ...]] = {
    (relation, predicate): own for relation, rules in _MEETINGS.items() for predicate, own in rules.items()}
