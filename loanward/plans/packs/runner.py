"""Runner pack: 60 rules, zero tolerance.  Numbers coincide with the foundation pack's
but many mean something else, so the ids have their own namespace."""

from __future__ import annotations

from loanward.plans.packs.foundation import FOUNDATION, category_of, orphan_count, totals
from loanward.plans.rule import Count, Pack, Rule, summed

#: Report categories by last rule number.
RUNNER_CATEGORIES = ((8, "Lifecycle"), (23, "State Machine"), (33, "Financial"), (38, "Payment"),
                     (45, "Credit"), (50, "Fraud"), (53, "Referential"), (60, "State"))

#: Status domains and status bands.
LOAN_STATUSES = ("('CURRENT', 'DELINQUENT_30', 'DELINQUENT_60', 'DELINQUENT_90', 'DELINQUENT_120', "
                 "'CHARGED_OFF', 'PAID_OFF', 'PREPAID')")
ACTIVE = "('CURRENT', 'DELINQUENT_30', 'DELINQUENT_60', 'DELINQUENT_90', 'DELINQUENT_120')"
PAYMENT_STATUSES = "('PAID', 'PARTIAL', 'MISSED', 'PENDING')"

ORPHAN_TRADELINES = summed(
    "report_ledger", "CASE WHEN reports = 0 OR credit_report_id IS NULL THEN lines END")


def _rule(number: int, title: str, relation: str, predicate: str, kind: str, **more) -> Rule:
    return Rule(f"RUN-{number:03d}", title, relation, predicate, kind,
                category=category_of(number, RUNNER_CATEGORIES), **more)


def _same(number: int) -> Rule:
    """The foundation rule of that number, judged with zero tolerance."""
    r = FOUNDATION.rule(f"FND-{number:03d}")
    return _rule(number, r.title, r.relation, r.predicate, r.kind, distinct=r.distinct, weight=r.weight,
                 reads=r.reads, count=r.count)


RUNNER = Pack("runner", (
    *(_same(n) for n in range(1, 8)),
    _rule(8, "Undecided application is not funded", "loan_application",
          "app_decision_status IN ('PENDING', 'UNDER_REVIEW')", "K03"),
    _same(9), _same(10),
    _rule(11, "Delinquent snapshot has a missed payment", "snapshot_without_missed",
          "loan_status LIKE '%DELINQUENT%'", "K02",
          count=summed("loan_ledger", "CASE WHEN missed = 0 OR loan_id IS NULL THEN delinquent END")),
    _same(12), _same(13),
    _rule(14, "Charged-off loan is 120 days past due", "loan_tape",
          "loan_status = 'CHARGED_OFF' AND days_past_due < 120", "K04"),
    _rule(15, "Days past due fit the status", "loan_tape",
          "(loan_status = 'DELINQUENT_30' AND NOT (days_past_due BETWEEN 30 AND 59)) OR "
          "(loan_status = 'DELINQUENT_60' AND NOT (days_past_due BETWEEN 60 AND 89)) OR "
          "(loan_status = 'DELINQUENT_90' AND NOT (days_past_due BETWEEN 90 AND 119)) OR "
          "(loan_status = 'DELINQUENT_120' AND days_past_due < 120)", "K05"),
    _rule(16, "Loan status is known", "loan_tape", f"loan_status NOT IN {LOAN_STATUSES}", "K06"),
    _rule(17, "Payment status is known", "payments", f"payment_status NOT IN {PAYMENT_STATUSES}", "K06"),
    _rule(18, "No snapshot lies in the future", "loan_tape", "snapshot_date > {as_of}", "K04"),
    _rule(19, "No payment lies in the future", "payments", "payment_received_date > {as_of}", "K04"),
    _rule(20, "Funding precedes the first due date", "loan_totals",
          "mark = 'open_origination' AND mark_date > first_due_date", "K12",
          reads=("loan_tape.origination_date", "loan_tape.loan_status", "payments.payment_due_date"),
          count=totals("mark = 'open_origination' AND mark_date > first_due_date")),
    _rule(21, "No payment before funding", "payment_marks",
          "mark = 'origination' AND payment_received_date < mark_date", "K03", reads=("loan_tape.origination_date",)),
    _rule(22, "Decision precedes funding", "origination_decision", "app_decision_date > origination_date", "K03"),
    _rule(23, "Snapshot dates advance", "loan_steps", "snapshot_date <= prev_snapshot_date", "K16",
          distinct="loan_id"),
    *(_same(n) for n in range(24, 28)),
    _rule(28, "Interest rate is between 1% and 40%", "loan_tape",
          "NOT (original_interest_rate BETWEEN 0.01D AND 0.40D)", "K05"),
    _same(29),
    _rule(30, "Principal paid is within the balance", "payment_snapshot",
          "principal_paid > current_principal_balance + 0.01D", "K03"),
    _rule(31, "Term is 6 to 360 months", "loan_tape", "NOT (original_term_months BETWEEN 6 AND 360)", "K05"),
    _rule(32, "Loan amount is positive", "loan_tape", "original_loan_amount <= 0", "K04"),
    _rule(33, "Active loan has an installment", "loan_tape",
          f"loan_status IN {ACTIVE} AND original_installment_amount <= 0", "K04"),
    _same(34),
    _rule(35, "Partial payment is between zero and schedule", "payments",
          "payment_status = 'PARTIAL' AND NOT (actual_payment_amount > 0 "
          "AND actual_payment_amount < scheduled_payment_amount_calc)", "K07"),
    _rule(36, "Paid means paid in full", "payments",
          "payment_status = 'PAID' AND abs(actual_payment_amount - scheduled_payment_amount_calc) > 0.02D", "K08"),
    _rule(37, "Interest paid is within interest accrued", "payments",
          "interest_paid > interest_accrued + 0.01D", "K07"),
    _rule(38, "Interest is paid before principal", "payments",
          "principal_paid > 0 AND interest_paid < interest_accrued - 0.01D", "K07"),
    _same(39),
    _rule(40, "Open trades are not negative", "credit_reports", "open_trades_count < 0", "K04"),
    _rule(41, "Inquiries are not negative", "credit_reports", "inquiries_last_6mo_count < 0", "K04"),
    _rule(42, "Past-due trades are within all trades", "credit_reports",
          "trades_currently_past_due_count > all_trades_count", "K07"),
    _rule(43, "Open trades are within all trades", "credit_reports", "open_trades_count > all_trades_count", "K07"),
    _rule(44, "Utilization is between 0 and 200%", "credit_reports",
          "NOT (revolving_utilization_ratio BETWEEN 0D AND 2.0D)", "K05"),
    _rule(45, "Oldest trade has an age", "credit_reports", "months_since_oldest_trade < 0", "K04"),
    _rule(46, "Approved applicant passed the fraud check", "fraud_application",
          "app_decision_status = 'APPROVED' AND fraud_check_status = 'FAILED'", "K03"),
    _rule(47, "Identity score is 0 to 100", "fraud_verification",
          "NOT (identity_verification_score BETWEEN 0 AND 100)", "K05"),
    _rule(48, "Fraud score is 0 to 999", "fraud_verification", "NOT (fraud_risk_score BETWEEN 0 AND 999)", "K05"),
    _rule(49, "Approved applicant has income verified", "fraud_application",
          "app_decision_status = 'APPROVED' AND income_verification_status IS NULL", "K10"),
    _rule(50, "Approved applicant has employment verified", "fraud_application",
          "app_decision_status = 'APPROVED' AND employment_verification_status IS NULL", "K10"),
    _rule(51, "Tradeline belongs to a report", "tradeline_orphan", "TRUE", "K01", count=ORPHAN_TRADELINES),
    _rule(52, "Fraud check belongs to an application", "fraud_orphan", "TRUE", "K01", count=orphan_count("checks")),
    _rule(53, "Bank transaction belongs to an application", "bank_orphan", "TRUE", "K01",
          count=orphan_count("transactions")),
    *(_same(n) for n in range(54, 57)),
    _rule(57, "Loans and payments name equally many loans", "loan_count_parity", "TRUE", "K20",
          weight="CASE WHEN abs(n_left - n_right) > 1000 THEN abs(n_left - n_right) ELSE 0 END", count=Count({
              "l": ("loan_ledger", "CASE WHEN snapshots > 0 THEN 1 END"),
              "p": ("loan_ledger", "CASE WHEN payments > 0 THEN 1 END")},
              "CASE WHEN abs({l} - {p}) > 1000 THEN abs({l} - {p}) ELSE 0 END")),
    _rule(58, "One credit report per application", "report_parity", "TRUE", "K19", weight="abs(n_left - n_right)",
          count=Count({"a": ("applications", "1"), "r": ("credit_reports", "1")}, "abs({a} - {r})")),
    _rule(59, "One fraud check per application", "fraud_parity", "TRUE", "K19", weight="abs(n_left - n_right)",
          count=Count({"a": ("applications", "1"), "f": ("fraud_verification", "1")}, "abs({a} - {f})")),
    _same(60),
))

#: The meaning in the rule's name where the coded rule tests something near it.
RUNNER_SPEC = Pack("runner_spec", (
    Rule("RUN-030", "Principal paid is within the balance before the payment", "payment_before_snapshot",
         "principal_paid > opening_balance + 0.01D", "K03", variant="spec", category="Financial"),
    Rule("RUN-011", "Delinquent loan has a missed payment", "snapshot_without_missed",
         "loan_status LIKE '%DELINQUENT%'", "K02", variant="distinct", category="State Machine", distinct="loan_id",
         count=summed("loan_ledger", "CASE WHEN delinquent > 0 AND (missed = 0 OR loan_id IS NULL) THEN 1 END")),
))

#: How far a row is beyond its bound, for rules with a measure: the worst are listed first.
RUNNER_EXCESS = {
    "RUN-012": "days_past_due",
    "RUN-013": "current_principal_balance",
    "RUN-014": "120 - days_past_due",
    "RUN-024": "-current_principal_balance",
    "RUN-026": "current_principal_balance - original_loan_amount",
    "RUN-028": "greatest(0.01D - original_interest_rate, original_interest_rate - 0.40D)",
    "RUN-029": "abs(principal_paid + interest_paid - actual_payment_amount)",
    "RUN-032": "-original_loan_amount",
    "RUN-034": "actual_payment_amount",
    "RUN-036": "abs(actual_payment_amount - scheduled_payment_amount_calc)",
    "RUN-037": "interest_paid - interest_accrued",
    "RUN-038": "interest_accrued - interest_paid",
    "RUN-042": "trades_currently_past_due_count - all_trades_count",
    "RUN-043": "open_trades_count - all_trades_count",
    "RUN-044": "greatest(-revolving_utilization_ratio, revolving_utilization_ratio - 2)",
    "RUN-047": "greatest(-identity_verification_score, identity_verification_score - 100)",
    "RUN-048": "greatest(-fraud_risk_score, fraud_risk_score - 999)",
}
