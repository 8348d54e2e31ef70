"""Foundation pack: 60 rules on impossible states.  All are critical.

A rule passes when its violations do not exceed its tolerance (rounded down).
"""

from __future__ import annotations

from loanward.plans.rule import ZERO, Base, Count, Pack, Rule, Tolerance, at_most, summed

#: Report categories by last rule number.
CATEGORIES = ((8, "Lifecycle"), (16, "State Machine"), (23, "Temporal"), (30, "Financial"),
              (38, "Payment"), (46, "Credit"), (53, "Fraud"), (60, "State"))

#: Status domains.
UNDECIDED = "('PENDING', 'UNDER_REVIEW', 'INCOMPLETE')"
LOAN_STATUSES = ("('CURRENT', 'DELINQUENT_30', 'DELINQUENT_60', 'DELINQUENT_90', 'DELINQUENT_120', "
                 "'CHARGED_OFF', 'PAID_OFF', 'PREPAID', 'CANCELLED', 'IN_FORBEARANCE')")
AGE = "(datediff(application_date, date_of_birth) / 365.25D)"

#: A null key matches nothing, so its rows are orphans.
NO_APPLICATION = "application_id IS NULL"
ORPHAN_PAYMENTS = summed("loan_ledger", "CASE WHEN snapshots = 0 OR loan_id IS NULL THEN payments END")
SURPLUS_APPLICATIONS = summed("application_ledger", "CASE WHEN apps > 1 THEN apps - 1 END")
SEEN = ("loan_tape.loan_status", "loan_tape.snapshot_date")


def orphan_count(measure: str) -> Count:
    """Rows of a child of applications whose application is absent."""
    return summed("application_ledger", f"CASE WHEN apps = 0 OR {NO_APPLICATION} THEN {measure} END")


def totals(predicate: str) -> Count:
    """Totals of a loan against its marks, counted in the join that payments use."""
    return summed("payment_marks", f"CASE WHEN side = 'total' AND {predicate} THEN _n END")


def category_of(number: int, ranges=CATEGORIES) -> str:
    return next(name for last, name in ranges if number <= last)


def _rule(number: int, title: str, relation: str, predicate: str, kind: str,
          tolerance: Tolerance = ZERO, **more) -> Rule:
    return Rule(f"FND-{number:03d}", title, relation, predicate, kind, tolerance,
                category=category_of(number), **more)


_ONE_PERCENT_OF_PAYMENTS = {"tolerance": at_most(0.01), "base": Base("payments")}

FOUNDATION = Pack("foundation", (
    _rule(1, "Funded loan has an approved application", "loan_application",
          "app_decision_status <> 'APPROVED'", "K03"),
    _rule(2, "Approved application has a credit report", "application_without_report",
          "decision_status = 'APPROVED'", "K02",
          count=summed("application_ledger", f"CASE WHEN reports = 0 OR {NO_APPLICATION} THEN approved END")),
    _rule(3, "Approved application has a fraud check", "application_without_fraud",
          "decision_status = 'APPROVED'", "K02",
          count=summed("application_ledger", f"CASE WHEN checks = 0 OR {NO_APPLICATION} THEN approved END")),
    _rule(4, "Payment belongs to a loan", "payment_orphan", "TRUE", "K01", count=ORPHAN_PAYMENTS),
    _rule(5, "Loan belongs to an application", "loan_orphan", "TRUE", "K01", count=orphan_count("snapshots")),
    _rule(6, "Credit report belongs to an application", "report_orphan", "TRUE", "K01", count=orphan_count("reports")),
    _rule(7, "Declined application is not funded", "loan_application", "app_decision_status = 'DECLINED'", "K03"),
    _rule(8, "Undecided application is not funded", "loan_application",
          f"app_decision_status IN {UNDECIDED}", "K03"),
    _rule(9, "No payment after payoff", "payment_marks",
          "mark_status = 'PAID_OFF' AND payment_received_date > last_seen", "K11", reads=SEEN),
    _rule(10, "No money received after charge-off", "payment_marks",
          "mark_status = 'CHARGED_OFF' AND payment_received_date > first_seen AND actual_payment_amount > 0", "K11",
          reads=SEEN),
    _rule(11, "Delinquent loan has not paid every month", "latest_snapshot",
          "loan_status LIKE '%DELINQUENT%' AND paid_count >= months_on_book", "K17"),
    _rule(12, "Current loan is not past due", "loan_tape", "loan_status = 'CURRENT' AND days_past_due > 0", "K04"),
    _rule(13, "Paid-off loan has no balance", "loan_tape",
          "loan_status = 'PAID_OFF' AND current_principal_balance > 0.01D", "K04"),
    _rule(14, "Charged-off loan has no balance", "loan_tape",
          "loan_status = 'CHARGED_OFF' AND current_principal_balance > 0.01D AND months_on_book > 4",
          "K04", at_most(0.05)),
    _rule(15, "No regular payment before the first due date", "payment_marks",
          "mark = 'first_due' AND payment_received_date < mark_date AND payment_type <> 'PREPAYMENT'", "K03",
          reads=("loan_tape.first_payment_due_date",), **_ONE_PERCENT_OF_PAYMENTS),
    _rule(16, "Loan status is known", "loan_tape", f"loan_status NOT IN {LOAN_STATUSES}", "K06"),
    _rule(17, "Credit report is not older than the application", "report_application",
          "report_date < app_application_date", "K03"),
    _rule(18, "Fraud check is not older than the application", "fraud_application",
          "to_date(fraud_check_timestamp) < app_application_date", "K03"),
    _rule(19, "Loan originates after application", "loan_application",
          "origination_date < app_application_date", "K03"),
    _rule(20, "First payment follows origination", "loan_totals",
          "mark = 'origination' AND first_received < mark_date", "K12",
          reads=("loan_tape.origination_date", "payments.payment_received_date"),
          count=totals("mark = 'origination' AND first_received < mark_date")),
    _rule(21, "No date lies in the future", "dated_records", "record_date > {as_of}", "K28", count=Count({
              "a": ("applications", "CASE WHEN to_date(application_date) > {as_of} THEN 1 END"),
              "l": ("loan_tape", "CASE WHEN to_date(snapshot_date) > {as_of} THEN 1 END"),
              "p": ("payments", "CASE WHEN to_date(payment_received_date) > {as_of} THEN 1 END")}, "{a} + {l} + {p}")),
    _rule(22, "Applicant was born before applying", "applications", "date_of_birth >= application_date", "K07"),
    _rule(23, "No payment before origination", "payment_marks",
          "mark = 'origination' AND payment_received_date < mark_date", "K03", reads=("loan_tape.origination_date",)),
    _rule(24, "Principal balance is not negative", "loan_tape", "current_principal_balance < 0", "K04"),
    _rule(25, "Payment amounts are not negative", "payments",
          "actual_payment_amount < 0 OR principal_paid < 0 OR interest_paid < 0", "K04"),
    _rule(26, "Balance stays within the original amount", "loan_tape",
          "current_principal_balance > 1.01D * original_loan_amount", "K07"),
    _rule(27, "Payments stay below three times the loan", "loan_totals",
          "mark = 'amount' AND total_paid > 3 * mark_amount", "K13",
          reads=("loan_tape.original_loan_amount", "payments.actual_payment_amount"),
          count=totals("mark = 'amount' AND total_paid > 3 * mark_amount")),
    _rule(28, "Interest-only loan bears interest", "loan_tape",
          "interest_only_indicator = TRUE AND original_interest_rate = 0", "K04"),
    _rule(29, "Payment parts add up", "payments",
          "abs(principal_paid + interest_paid - actual_payment_amount) > 0.02D", "K08"),
    _rule(30, "Origination fee is below the loan amount", "loan_tape",
          "origination_fee >= original_loan_amount", "K07"),
    _rule(31, "Posted payment has a received date", "payments",
          "payment_status = 'POSTED' AND payment_received_date IS NULL", "K10"),
    _rule(32, "Open loan has a scheduled payment", "payment_marks",
          "mark_status NOT IN ('PAID_OFF', 'CHARGED_OFF') AND scheduled_payment_amount <= 0", "K03",
          reads=("loan_tape.loan_status",)),
    _rule(33, "Payment is not above schedule", "payments",
          "actual_payment_amount > 1.05D * scheduled_payment_amount "
          "AND payment_type NOT IN ('PREPAYMENT', 'PAYOFF') AND is_extra_payment = FALSE", "K04",
          **_ONE_PERCENT_OF_PAYMENTS),
    _rule(34, "Missed payment has no amount", "payments",
          "payment_status = 'MISSED' AND actual_payment_amount > 0", "K04"),
    _rule(35, "Late payment has a late fee", "payments",
          "days_late > coalesce(grace_period_days, 15) AND payment_status = 'POSTED' "
          "AND late_fee_assessed = 0 AND late_fee_waived = FALSE", "K04", at_most(0.20)),
    _rule(36, "Unfunded payment is returned", "payments", "nsf_flag = TRUE AND returned_flag = FALSE", "K04"),
    _rule(37, "Returned payment has a return date", "payments",
          "returned_flag = TRUE AND return_date IS NULL", "K10"),
    _rule(38, "Failed autopay has a reason", "payments",
          "autopay_flag = TRUE AND payment_status IN ('RETURNED', 'REVERSED') AND return_reason_code IS NULL",
          "K10", at_most(0.10, minimum=1),
          base=Base("payments", "autopay_flag = TRUE AND payment_status IN ('RETURNED', 'REVERSED')")),
    _rule(39, "Bureau score is in range", "credit_reports", "NOT (fico_score_8 BETWEEN 300 AND 850)", "K05"),
    _rule(40, "Credit file is younger than its holder", "report_application",
          "file_since_date < app_date_of_birth", "K03"),
    _rule(41, "Bankruptcy is a public record", "credit_reports",
          "bankruptcies_count > 0 AND public_records_count = 0", "K04"),
    _rule(42, "Utilization is below 200%", "credit_reports", "revolving_utilization_ratio > 2.0D", "K04",
          at_most(0.001)),
    _rule(43, "Open trades are within all trades", "credit_reports",
          "all_trades_open_count > all_trades_count", "K07"),
    _rule(44, "Open tradeline is within its limit", "credit_tradelines",
          "current_balance > 1.10D * credit_limit AND account_status = 'OPEN'", "K07", at_most(0.05)),
    _rule(45, "Closed tradeline has no payment", "credit_tradelines",
          "account_status = 'CLOSED' AND monthly_payment > 0", "K04"),
    _rule(46, "Tradeline opened before the report", "tradeline_report", "open_date > rep_report_date", "K03"),
    _rule(47, "Approved applicant is alive", "fraud_application",
          "ssn_deceased_flag = TRUE AND app_decision_status = 'APPROVED'", "K03"),
    _rule(48, "Number was issued after birth", "fraud_application",
          "ssn_issued_start_year < year(app_date_of_birth)", "K03", at_most(0.01), base=Base("applications")),
    _rule(49, "Approved applicant passed the identity check", "fraud_application",
          "identity_verification_result = 'FAIL' AND app_decision_status = 'APPROVED'", "K03"),
    _rule(50, "Approved applicant is no critical fraud risk", "fraud_application",
          "fraud_risk_tier = 'CRITICAL' AND app_decision_status = 'APPROVED'", "K03"),
    _rule(51, "Applicant is 18 to 100 years old", "applications", f"{AGE} < 18 OR {AGE} > 100", "K34"),
    _rule(52, "Email has a domain", "applications",
          r"email_address IS NOT NULL AND NOT email_address RLIKE '@.*[.]'", "K09",
          at_most(0.01, minimum=1), base=Base("applications", "email_address IS NOT NULL")),
    _rule(53, "Phone has ten digits", "applications",
          "phone_primary IS NOT NULL AND length(regexp_replace(phone_primary, '[^0-9]', '')) <> 10", "K09",
          Tolerance("strict_lt", share=0.01), variant="spec"),
    _rule(54, "No life after payoff", "loan_steps",
          "prev_loan_status = 'PAID_OFF' AND loan_status <> 'PAID_OFF'", "K14", distinct="loan_id"),
    _rule(55, "No life after charge-off", "loan_steps",
          "prev_loan_status = 'CHARGED_OFF' AND loan_status <> 'CHARGED_OFF'", "K14", distinct="loan_id"),
    _rule(56, "Open balance does not grow", "loan_steps",
          "loan_status NOT IN ('CHARGED_OFF', 'PAID_OFF') "
          "AND current_principal_balance > opened_current_principal_balance + 1.0D", "K15"),
    _rule(57, "Days past due grow or cure", "loan_steps",
          "days_past_due < prev_days_past_due AND days_past_due > 0", "K15"),
    _rule(58, "Months on book advance by one", "loan_steps",
          "months_on_book <> prev_months_on_book + 1 "
          "AND datediff(snapshot_date, prev_snapshot_date) BETWEEN 28 AND 35", "K16",
          at_most(0.05), base=Base("loan_tape")),
    _rule(59, "Payments do not outnumber months", "latest_snapshot", "payment_count > months_on_book + 2", "K17",
          at_most(0.01)),
    _rule(60, "Application key is unique", "application_keys", "copies > 1", "K18", weight="copies - 1",
          count=SURPLUS_APPLICATIONS),
))

#: The 29 rules of the reduced selection.
REDUCED = FOUNDATION.select(f"FND-{n:03d}" for n in (
    1, 2, 3, 4, 7, 9, 10, 12, 13, 16, 17, 19, 22, 23, 24, 25, 26, 29, 30, 31, 34, 36, 37, 39, 43, 47, 51, 54, 60))

#: Forms of the written specification where they differ from the coded rule.
FOUNDATION_SPEC = Pack("foundation_spec", (
    Rule("FND-018", "Fraud check is not older than the application time", "fraud_application",
         "fraud_check_timestamp < app_application_timestamp", "K03", variant="spec", category="Temporal"),
    Rule("FND-029", "Payment parts and fees add up", "payments",
         "abs(principal_paid + interest_paid + coalesce(fees_paid, 0) + coalesce(late_fee_paid, 0) "
         "- actual_payment_amount) > 0.02D", "K08", variant="spec", category="Financial"),
    Rule("FND-039", "Bureau scores are in range", "credit_reports",
         "NOT (fico_score_8 BETWEEN 300 AND 850) OR NOT (vantage_score_3 BETWEEN 300 AND 850)",
         "K05", variant="spec", category="Credit"),
    Rule("FND-052", "Email has a domain and a plausible length", "applications",
         "email_address NOT LIKE '%@%.%' OR length(email_address) < 5", "K09",
         Tolerance("strict_lt", share=0.01), variant="spec", category="Fraud"),
))
