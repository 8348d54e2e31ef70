"""Clean lending families and seeded faults.

Family ``i`` is one application with a loan of six month-end snapshots, six payments, a
report, two tradelines, a fraud check and a bank transaction.  All are free of faults; a
fault changes one column of one family.
"""

from __future__ import annotations

from loanward.sources.tables import Tables

FAMILIES = 140
SNAPSHOTS = 6

_BAL = "(12000.0D - 100 * m)"
_GROWTH = "power(1 + 0.12D / 12, 36)"
_PMT = f"(12000.0D * (0.12D / 12) * {_GROWTH} / ({_GROWTH} - 1))"

CLEAN: dict[str, dict[str, str]] = {
    "applications": {
        "application_id": "'A' || i", "customer_id": "'C' || i", "application_date": "DATE '2022-01-10'",
        "decision_date": "DATE '2022-01-12'", "application_timestamp": "TIMESTAMP '2022-01-10 00:00:00'",
        "date_of_birth": "date_add(DATE '1980-01-01', i)", "decision_status": "'APPROVED'",
        "fico_score_at_application": "700", "debt_to_income_ratio": "0.3D", "annual_income": "60000.0D",
        "product_type": "'PERSONAL'", "channel": "'WEB'", "state": "'CA'", "address_state": "'CA'",
        "address_zip": "'90210'", "ssn_last4": "lpad(i + 1, 4, '0')", "ssn_hash": "'H' || i",
        "email_address": "'a' || i || '@mail.com'", "phone_primary": "'212-555-0100'",
    },
    "loan_tape": {
        "loan_id": "'L' || i", "application_id": "'A' || i", "customer_id": "'C' || i",
        "snapshot_date": "last_day(add_months(DATE '2022-02-01', m))", "origination_date": "DATE '2022-02-01'",
        "first_payment_due_date": "DATE '2022-03-01'", "note_signature_date": "DATE '2022-01-30'",
        "maturity_date": "DATE '2025-02-01'", "loan_status": "'CURRENT'", "grade": "'B'", "subgrade": "'B2'",
        "vintage_month": "'2022-02'", "vintage_year": "2022", "loan_payment_history": "'000000'",
        "months_on_book": "m", "days_past_due": "0", "worst_days_past_due": "0", "original_term_months": "36",
        "times_30_dpd": "0", "times_60_dpd": "0", "times_90_dpd": "0", "times_120_dpd": "0",
        "months_since_last_delinquency": "12", "current_principal_balance": _BAL,
        "current_interest_balance": "10.0D", "current_fees_balance": "0.0D", "payoff_amount": f"{_BAL} + 10",
        "disbursed_amount": "11700.0D", "original_loan_amount": "12000.0D", "original_interest_rate": "0.12D",
        "original_apr": "0.14D", "original_installment_amount": _PMT, "origination_fee": "300.0D",
        "chargeoff_flag": "0", "default_flag": "0", "delinquent_flag": "FALSE", "interest_only_indicator": "FALSE",
        "never_paid_flag": "FALSE", "delinquent_0_30_flag": "FALSE", "delinquent_31_60_flag": "FALSE",
        "delinquent_61_90_flag": "FALSE", "delinquent_91_120_flag": "FALSE",
    },
    "payments": {
        "payment_id": "'P' || i || '-' || m", "loan_id": "'L' || i", "customer_id": "'C' || i",
        "payment_due_date": "last_day(add_months(DATE '2022-02-01', m))",
        "payment_received_date": "last_day(add_months(DATE '2022-02-01', m))",
        "snapshot_date": "last_day(add_months(DATE '2022-02-01', m))", "return_date": "CAST(NULL AS DATE)",
        "payment_status": "'PAID'", "payment_type": "'REGULAR'", "payment_method": "'ACH'",
        "payment_channel": "'WEB'", "return_reason_code": "CAST(NULL AS STRING)",
        "scheduled_payment_amount": "100.0D", "scheduled_payment_amount_calc": "100.0D",
        "actual_payment_amount": "100.0D", "principal_paid": "80.0D", "interest_paid": "20.0D",
        "interest_accrued": "20.0D", "beginning_principal_balance": "1000.0D", "ending_principal_balance": "920.0D",
        "fees_paid": "0.0D", "late_fee_paid": "0.0D", "late_fee_assessed": "0.0D", "suspense_amount": "0.0D",
        "unapplied_amount": "0.0D", "days_late": "0", "grace_period_days": "10", "nsf_flag": "FALSE",
        "returned_flag": "FALSE", "autopay_flag": "TRUE", "late_fee_waived": "FALSE", "is_extra_payment": "FALSE",
    },
    "credit_reports": {
        "credit_report_id": "'R' || i", "application_id": "'A' || i", "report_date": "DATE '2022-01-11'",
        "file_since_date": "DATE '2005-01-01'", "fico_score_8": "700", "vantage_score_3": "690",
        "all_trades_count": "10", "all_trades_open_count": "6", "open_trades_count": "6",
        "bankcard_trades_count": "2", "bankcard_trades_open_count": "1", "revolving_trades_count": "4",
        "revolving_trades_open_count": "2", "installment_trades_count": "4", "installment_trades_open_count": "2",
        "mortgage_trades_count": "2", "trades_currently_past_due_count": "0", "inquiries_6mo_count": "1",
        "inquiries_last_6mo_count": "1", "public_records_count": "0", "bankruptcies_count": "0",
        "delinquency_30_day_count": "0", "months_since_oldest_trade": "100", "revolving_utilization_ratio": "0.4D",
        "bureau_code": "'TU'",
    },
    "credit_tradelines": {
        "tradeline_id": "'T' || i", "credit_report_id": "'R' || i", "account_type": "'REVOLVING'",
        "account_status": "'OPEN'", "current_balance": "500.0D", "credit_limit": "1000.0D",
        "monthly_payment": "25.0D", "open_date": "DATE '2015-01-01'", "times_30dpd": "0", "times_60dpd": "0",
        "times_90dpd": "0",
    },
    "fraud_verification": {
        "application_id": "'A' || i", "fraud_check_timestamp": "TIMESTAMP '2022-01-11 00:00:00'",
        "fraud_check_status": "'PASSED'", "fraud_risk_score": "100", "income_verification_status": "'VERIFIED'",
        "employment_verification_status": "'VERIFIED'", "identity_verification_score": "90",
        "synthetic_identity_score": "5", "overall_fraud_score": "700", "identity_verification_result": "'PASS'",
        "fraud_risk_tier": "'LOW'", "ssn_deceased_flag": "FALSE", "address_verified": "TRUE",
        "ssn_issued_start_year": "1990",
    },
    "bank_transactions": {
        "transaction_id": "'X' || i", "application_id": "'A' || i", "bank_acct_id": "'B' || i",
        "transaction_date": "TIMESTAMP '2022-01-05 00:00:00'", "amount": "10.0D", "type": "'DEBIT'",
        "category": "'food'", "merchant": "'m'", "description": "'d'",
    },
}

#: (rules that must fire, table, column, faulty value, condition on the snapshot ``m`` or None)
FAULTS: list[tuple[str, str, str, str, str | None]] = [
    ("FND-001 FND-007 RUN-001 RUN-007 POL-003", "applications", "decision_status", "'DECLINED'", None),
    ("FND-008 RUN-008", "applications", "decision_status", "'PENDING'", None),
    ("FND-002 FND-006 INT-003 RUN-002 RUN-006", "credit_reports", "application_id", "'none'", None),
    ("FND-003 RUN-003 RUN-052 INT-006/spec", "fraud_verification", "application_id", "'none'", None),
    ("FND-004 INT-004 RUN-004", "payments", "loan_id", "NULL", "m = 2"),
    ("FND-004 FND-006", "credit_reports", "application_id", "NULL", None),
    ("FND-005 INT-002 RUN-005 GEN-002", "loan_tape", "application_id", "'none'", None),
    ("INT-005 RUN-051", "credit_tradelines", "credit_report_id", "'none'", None),
    ("INT-007 RUN-053", "bank_transactions", "application_id", "'none'", None),
    ("FND-009 RUN-009", "loan_tape", "loan_status", "'PAID_OFF'", "m = 1"),
    ("FND-010 RUN-010 RUN-014 POL-010", "loan_tape", "loan_status", "'CHARGED_OFF'", "m = 3"),
    ("FND-012 RUN-012 LOG-001 LOG-002 LOG-005", "loan_tape", "days_past_due", "5", "m = 3"),
    ("FND-013 RUN-013 FND-054 RUN-054 GEN-003", "loan_tape", "loan_status", "'PAID_OFF'", "m = 2"),
    ("FND-055 RUN-055", "loan_tape", "loan_status", "'CHARGED_OFF'", "m = 2"),
    ("FND-016 RUN-016", "loan_tape", "loan_status", "'FROZEN'", None),
    ("RUN-016", "loan_tape", "loan_status", "'IN_FORBEARANCE'", None),
    ("FND-017", "credit_reports", "report_date", "DATE '2022-01-09'", None),
    ("FND-018 FND-018/spec", "fraud_verification", "fraud_check_timestamp", "TIMESTAMP '2022-01-09 12:00:00'", None),
    ("FND-019 TMP-001", "applications", "application_date", "DATE '2022-02-02'", None),
    ("FND-020 FND-023 RUN-021", "payments", "payment_received_date", "DATE '2022-01-15'", "m = 1"),
    ("RUN-020", "payments", "payment_due_date", "DATE '2022-01-15'", "m = 1"),
    ("FND-021 RUN-018", "loan_tape", "snapshot_date", "DATE '2024-01-01'", "m = 6"),
    ("FND-021 RUN-019", "payments", "payment_received_date", "DATE '2024-01-01'", "m = 6"),
    ("FND-022", "applications", "date_of_birth", "DATE '2022-01-10'", None),
    ("RUN-022", "applications", "decision_date", "DATE '2022-02-02'", None),
    ("FND-024 RUN-024 DQ-011", "loan_tape", "current_principal_balance", "-1.0D", "m = 6"),
    ("FND-025 RUN-025", "payments", "interest_paid", "-1.0D", "m = 2"),
    ("FND-026 RUN-026 FIN-001 FND-056 RUN-056 FIN-010", "loan_tape", "current_principal_balance", "13000.0D", "m = 4"),
    ("FND-027 RUN-027", "payments", "actual_payment_amount", "40000.0D", "m = 2"),
    ("FND-028 RUN-028", "loan_tape", "original_interest_rate, interest_only_indicator", "0.0D; TRUE", None),
    ("FND-029 RUN-029 FIN-002 FND-029/spec RUN-037", "payments", "interest_paid", "20.5D", "m = 2"),
    ("FND-030 FIN-007", "loan_tape", "origination_fee", "12000.0D", None),
    ("FND-031 RUN-017", "payments", "payment_status, payment_received_date", "'POSTED'; NULL", "m = 2"),
    ("FND-032 RUN-036", "payments", "scheduled_payment_amount, scheduled_payment_amount_calc", "0.0D; 0.0D", "m = 2"),
    ("FND-034 RUN-034", "payments", "payment_status", "'MISSED'", "m = 2"),
    ("FND-036", "payments", "nsf_flag", "TRUE", "m = 2"),
    ("FND-037", "payments", "returned_flag", "TRUE", "m = 2"),
    ("FND-039 RUN-039 FND-039/spec", "credit_reports", "fico_score_8", "299", None),
    ("FND-039/spec", "credit_reports", "vantage_score_3", "851", None),
    ("FND-040 TMP-007", "credit_reports", "file_since_date", "DATE '1979-12-31'", None),
    ("FND-041", "credit_reports", "bankruptcies_count", "1", None),
    ("FND-043", "credit_reports", "all_trades_open_count", "11", None),
    ("FND-045", "credit_tradelines", "account_status", "'CLOSED'", None),
    ("FND-046 TMP-009", "credit_tradelines", "open_date", "DATE '2022-01-12'", None),
    ("TMP-009", "credit_tradelines", "open_date", "DATE '1960-01-01'", None),
    ("FND-047", "fraud_verification", "ssn_deceased_flag", "TRUE", None),
    ("FND-049", "fraud_verification", "identity_verification_result", "'FAIL'", None),
    ("FND-050", "fraud_verification", "fraud_risk_tier", "'CRITICAL'", None),
    ("FND-051 POL-009", "applications", "date_of_birth", "DATE '2004-01-12'", None),
    ("FND-051", "applications", "date_of_birth", "DATE '1921-12-01'", None),
    ("FND-057 RUN-015", "loan_tape", "days_past_due, loan_status", "CASE m WHEN 3 THEN 70 ELSE 20 END; 'DELINQUENT_30'", "m IN (3, 4)"),
    ("FND-060 RUN-060 INT-001", "applications", "application_id", "'A0'", None),
    ("INT-006", "fraud_verification", "application_id", "'A0'", None),
    ("RUN-023 INT-001", "loan_tape", "snapshot_date", "DATE '2022-03-31'", "m IN (1, 2)"),
    ("RUN-011", "loan_tape", "loan_status, days_past_due", "'DELINQUENT_30'; 31", "m = 4"),
    ("RUN-030 RUN-030/spec", "payments", "principal_paid", "13000.0D", "m = 3"),
    ("RUN-031", "loan_tape", "original_term_months", "5", None),
    ("RUN-032", "loan_tape", "original_loan_amount", "0.0D", None),
    ("RUN-033", "loan_tape", "original_installment_amount", "0.0D", None),
    ("RUN-035", "payments", "payment_status", "'PARTIAL'", "m = 3"),
    ("RUN-038", "payments", "interest_paid", "19.0D", "m = 3"),
    ("RUN-040", "credit_reports", "open_trades_count", "-1", None),
    ("RUN-041", "credit_reports", "inquiries_last_6mo_count", "-1", None),
    ("RUN-042", "credit_reports", "trades_currently_past_due_count", "11", None),
    ("RUN-043", "credit_reports", "open_trades_count", "11", None),
    ("RUN-044", "credit_reports", "revolving_utilization_ratio", "-0.1D", None),
    ("RUN-045", "credit_reports", "months_since_oldest_trade", "-1", None),
    ("RUN-046", "fraud_verification", "fraud_check_status", "'FAILED'", None),
    ("RUN-047", "fraud_verification", "identity_verification_score", "101", None),
    ("RUN-048", "fraud_verification", "fraud_risk_score", "1000", None),
    ("RUN-049", "fraud_verification", "income_verification_status", "NULL", None),
    ("RUN-050", "fraud_verification", "employment_verification_status", "NULL", None),
    ("INT-008 HYD-006", "loan_tape", "customer_id", "'other'", None),
    ("INT-008/spec", "payments", "customer_id", "'other'", "m = 1"),
    ("POL-001 GEN-001", "applications", "fico_score_at_application", "639", None),
    ("POL-002", "applications", "debt_to_income_ratio", "0.51D", None),
    ("POL-004", "loan_tape", "original_loan_amount", "50001.0D", None),
    ("POL-005", "loan_tape", "original_apr", "0.37D", None),
    ("POL-006", "loan_tape", "original_term_months", "30", None),
    ("TMP-002", "loan_tape", "note_signature_date", "DATE '2022-02-02'", None),
    ("TMP-003", "loan_tape", "first_payment_due_date", "DATE '2022-02-01'", None),
    ("TMP-008", "loan_tape", "months_since_last_delinquency", "0", None),
    ("TMP-010 TMP-010/spec", "loan_tape", "vintage_month", "'2022-03'", None),
    ("TMP-010/spec", "loan_tape", "vintage_year", "2021", None),
    ("FIN-005", "payments", "ending_principal_balance", "921.0D", "m = 1"),
    ("LOG-003", "credit_reports", "revolving_trades_count", "11", None),
    ("LOG-004", "loan_tape", "delinquent_31_60_flag", "TRUE", "m = 1"),
    ("LOG-006 LOG-006/spec", "loan_tape", "times_60_dpd", "1", None),
    ("LOG-006/spec", "loan_tape", "times_120_dpd", "1", None),
    ("LOG-012", "loan_tape", "months_on_book", "101", "m = 6"),
    ("LOG-012/spec", "loan_tape", "origination_date", "DATE '2022-01-31'", None),
    ("LOG-013", "loan_tape", "never_paid_flag", "TRUE", None),
    ("DQ-001", "applications", "fico_score_at_application", "299", None),
    ("DQ-002", "applications", "annual_income", "0.0D", None),
    ("DQ-005 DQ-005/spec", "applications", "ssn_last4", "'0000'", None),
    ("DQ-005/spec", "applications", "ssn_last4", "'12a4'", None),
    ("DQ-007", "applications", "phone_primary", "'2125550100'", None),
    ("DQ-008 DQ-008/spec", "applications", "address_zip", "'1234'", None),
    ("DQ-008/spec", "applications", "address_zip", "'9021x'", None),
    ("DQ-009", "applications", "address_state", "'ZZ'", None),
    ("DQ-010", "applications", "application_date", "DATE '2019-12-31'", None),
    ("HYD-002", "loan_tape", "times_30_dpd, months_since_last_delinquency", "1; 999", None),
    ("HYD-011", "loan_tape", "subgrade", "'C2'", None),
    ("CHK-005", "loan_tape", "vintage_month", "NULL", None),
    ("CHK-008", "loan_tape", "chargeoff_flag", "1", None),
    ("CHK-009", "credit_reports", "bankcard_trades_open_count", "3", None),
    ("CHK-010", "loan_tape", "loan_status, days_past_due", "'DELINQUENT_60'; 61", "m = 5"),
    ("CHK-011", "payments", "loan_id", "'none'", None),
    # Rules with a relative tolerance: checked by the matching rows.
    ("FND-014", "loan_tape", "loan_status", "'CHARGED_OFF'", "m = 5"),
    ("FND-015", "payments", "payment_received_date", "DATE '2022-02-15'", "m = 1"),
    ("FND-033", "payments", "actual_payment_amount", "106.0D", "m = 1"),
    ("FND-035", "payments", "payment_status, days_late", "'POSTED'; 11", "m = 1"),
    ("FND-038", "payments", "payment_status", "'RETURNED'", "m = 1"),
    ("FND-042", "credit_reports", "revolving_utilization_ratio", "2.1D", None),
    ("FND-044", "credit_tradelines", "current_balance", "1101.0D", None),
    ("FND-048 LOG-015", "fraud_verification", "ssn_issued_start_year", "1970", None),
    ("FND-052 DQ-006 FND-052/spec", "applications", "email_address", "'nobody'", None),
    ("FND-053", "applications", "phone_primary", "'212-555-010'", None),
    ("FND-058", "loan_tape", "months_on_book", "9", "m = 3"),
    ("POL-007", "applications", "annual_income", "30000.0D", None),
    ("POL-008", "credit_reports", "report_date", "DATE '2022-02-11'", None),
    ("TMP-004", "loan_tape", "maturity_date", "DATE '2025-02-09'", None),
    ("TMP-005", "payments", "payment_received_date", "date_sub(last_day(add_months(DATE '2022-02-01', m)), 31)", "m = 5"),
    ("TMP-006", "loan_tape", "snapshot_date", "DATE '2022-05-20'", "m = 3"),
    ("FIN-003", "loan_tape", "original_installment_amount", f"{_PMT} + 1.01D", None),
    ("FIN-006", "loan_tape", "original_apr", "0.171D", None),
    ("FIN-008", "loan_tape", "disbursed_amount", "11701.5D", None),
    ("FIN-009", "loan_tape", "payoff_amount", "20.0D", None),
    ("LOG-007", "loan_tape", "loan_payment_history", "'000100'", None),
    ("LOG-008", "credit_reports", "fico_score_8", "721", None),
    ("LOG-009", "credit_reports", "revolving_utilization_ratio", "1.6D", None),
    ("LOG-010", "credit_reports", "all_trades_count", "14", None),
    ("LOG-011", "credit_reports", "bankruptcies_count, public_records_count", "1; 1", None),
    ("HYD-001", "loan_tape", "loan_status, days_past_due", "'DELINQUENT_90'; 95", "m = 6"),
]


#: Faults of more than one column or table that the list above cannot say.
PAIRED = {
    "POL-007": ("loan_tape", "original_loan_amount", "30000.0D"),
    "LOG-013": ("payments", "payment_status", "'POSTED'"),
}


def _tables(spark, exprs) -> Tables:
    ids = spark.range(FAMILIES).selectExpr("CAST(id AS INT) AS i")
    many = ids.selectExpr("i", f"explode(sequence(1, {SNAPSHOTS})) AS m")
    frames = {}
    for table, columns in exprs.items():
        base = many if table in ("loan_tape", "payments") else ids.selectExpr("i", "1 AS m")
        frames[table] = base.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    return Tables(frames)


def clean(spark) -> Tables:
    return _tables(spark, CLEAN)


def faulty(spark) -> Tables:
    """Fault number ``k`` sits in family ``k + 1``; family 0 stays clean."""
    exprs = {t: dict(c) for t, c in CLEAN.items()}

    def plant(family: int, table: str, column: str, value: str, when: str | None) -> None:
        condition = f"i = {family}" + (f" AND {when}" if when else "")
        exprs[table][column] = f"CASE WHEN {condition} THEN {value} ELSE {exprs[table][column]} END"

    for k, (rules, table, columns, values, when) in enumerate(FAULTS):
        for column, value in zip(columns.split(", "), values.split("; ")):
            plant(k + 1, table, column, value, when)
        for rule, (other, column, value) in PAIRED.items():
            if rule in rules.split():
                plant(k + 1, other, column, value, None)
    return _tables(spark, exprs)
