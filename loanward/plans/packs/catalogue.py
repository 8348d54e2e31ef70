"""Integrity catalogue: 87 rules in eight groups, with severities.

Relative tolerances are strict here: violations < share * rows.
"""

from __future__ import annotations

from loanward.plans.packs.foundation import AGE, ORPHAN_PAYMENTS, SURPLUS_APPLICATIONS, orphan_count
from loanward.plans.packs.runner import ORPHAN_TRADELINES
from loanward.plans.rule import INFORMATION, ZERO, Base, Count, Pack, Rule, Tolerance, band, below, summed

CRITICAL, HIGH, MEDIUM, LOW = "CRITICAL", "HIGH", "MEDIUM", "LOW"

#: Group names by id prefix.
GROUPS = {"INT": "Referential", "POL": "Policy", "TMP": "Temporal", "FIN": "Financial", "LOG": "Logic",
          "STAT": "Statistics", "DQ": "Data Quality", "HYD": "Hydration", "CHK": "Checklist"}

#: The fifty state codes.
STATES = ("('AL','AK','AZ','AR','CA','CO','CT','DE','FL','GA','HI','ID','IL','IN','IA','KS','KY','LA','ME','MD',"
          "'MA','MI','MN','MS','MO','MT','NE','NV','NH','NJ','NM','NY','NC','ND','OH','OK','OR','PA','RI','SC',"
          "'SD','TN','TX','UT','VT','VA','WA','WV','WI','WY')")

MONTHLY = "(original_interest_rate / 12D)"
GROWTH = f"power(1 + {MONTHLY}, original_term_months)"
INSTALLMENT = (f"CASE WHEN original_interest_rate = 0 THEN try_divide(original_loan_amount, original_term_months) "
               f"ELSE try_divide(original_loan_amount * {MONTHLY} * {GROWTH}, {GROWTH} - 1) END")
MONTH_GAP = ("(year(snapshot_date) * 12 + month(snapshot_date) "
             "- year(origination_date) * 12 - month(origination_date))")


def _rule(rule_id: str, severity: str, title: str, relation: str, predicate: str, kind: str,
          tolerance: Tolerance = ZERO, **more) -> Rule:
    return Rule(rule_id, title, relation, predicate, kind, tolerance, severity=severity,
                category=GROUPS[rule_id.split("-")[0]], **more)


CATALOGUE = Pack("catalogue", (
    _rule("INT-001", CRITICAL, "Primary keys are unique", "primary_keys", "copies > 1", "K18", weight="copies - 1",
          count=Count({"a": SURPLUS_APPLICATIONS.parts["v"], "l": ("snapshot_keys", "copies - 1")}, "{a} + {l}")),
    _rule("INT-002", CRITICAL, "Loan belongs to an application", "loan_orphan", "TRUE", "K01", count=orphan_count("snapshots")),
    _rule("INT-003", CRITICAL, "Credit report belongs to an application", "report_orphan", "TRUE", "K01", count=orphan_count("reports")),
    _rule("INT-004", CRITICAL, "Payment belongs to a loan", "payment_orphan", "TRUE", "K01", count=ORPHAN_PAYMENTS),
    _rule("INT-005", CRITICAL, "Tradeline belongs to a report", "tradeline_orphan", "TRUE", "K01", count=ORPHAN_TRADELINES),
    _rule("INT-006", HIGH, "Fraud check occurs once per application", "fraud_groups", "copies <> 1", "K21",
          count=summed("application_ledger", "CASE WHEN checks > 1 THEN 1 END")),
    _rule("INT-007", MEDIUM, "Bank transaction belongs to an application", "bank_orphan", "TRUE", "K01",
          count=orphan_count("transactions")),
    _rule("INT-008", HIGH, "Loan and application name one customer", "loan_application",
          "customer_id <> app_customer_id", "K22"),

    _rule("POL-001", CRITICAL, "Approved score is at least 640", "applications",
          "decision_status = 'APPROVED' AND fico_score_at_application < 640", "K04"),
    _rule("POL-002", HIGH, "Approved debt ratio is at most 50%", "applications",
          "decision_status = 'APPROVED' AND debt_to_income_ratio > 0.50D", "K04"),
    _rule("POL-003", CRITICAL, "Only approved applications are funded", "loan_application",
          "app_decision_status <> 'APPROVED'", "K03"),
    _rule("POL-004", MEDIUM, "Loan amount fits the product", "loan_application",
          "(app_product_type = 'PERSONAL' AND (original_loan_amount < 1000 OR original_loan_amount > 50000)) OR "
          "(app_product_type = 'AUTO' AND (original_loan_amount < 5000 OR original_loan_amount > 100000))", "K03"),
    _rule("POL-005", HIGH, "Annual percentage rate is 5% to 36%", "loan_tape",
          "original_apr < 0.05D OR original_apr > 0.36D", "K05"),
    _rule("POL-006", MEDIUM, "Personal loan has a standard term", "loan_application",
          "app_product_type = 'PERSONAL' AND original_term_months NOT IN (12, 24, 36, 48, 60)", "K03"),
    _rule("POL-007", MEDIUM, "Large loan has income", "loan_application",
          "original_loan_amount > 25000 AND app_annual_income < 40000 AND app_decision_status = 'APPROVED'",
          "K03", below(0.05)),
    _rule("POL-008", MEDIUM, "Report is fresh", "report_application",
          "abs(datediff(app_application_date, report_date)) > 30", "K03", below(0.01)),
    _rule("POL-009", CRITICAL, "Applicant is an adult", "applications", f"{AGE} < 18", "K34"),
    _rule("POL-010", HIGH, "Charged-off loan is 120 days past due", "loan_tape",
          "loan_status = 'CHARGED_OFF' AND days_past_due < 120", "K04"),

    _rule("TMP-001", CRITICAL, "Loan originates after application", "loan_application",
          "origination_date < app_application_date", "K03"),
    _rule("TMP-002", HIGH, "Note is signed before origination", "loan_tape",
          "note_signature_date > origination_date", "K07"),
    _rule("TMP-003", HIGH, "First due date follows origination", "loan_tape",
          "first_payment_due_date <= origination_date", "K07"),
    _rule("TMP-004", MEDIUM, "Maturity fits the term", "loan_tape",
          "abs(datediff(maturity_date, first_payment_due_date) - (original_term_months - 1) * 30.44D) > 5",
          "K08", below(0.01)),
    _rule("TMP-005", LOW, "No payment a month early", "payments",
          "datediff(payment_due_date, payment_received_date) > 30", "K07", below(0.001)),
    _rule("TMP-006", MEDIUM, "Snapshots are a month apart", "loan_steps",
          "datediff(snapshot_date, prev_snapshot_date) > 35 OR datediff(snapshot_date, prev_snapshot_date) < 25",
          "K16", below(0.05)),
    _rule("TMP-007", CRITICAL, "Credit file is younger than its holder", "report_application",
          "file_since_date < app_date_of_birth", "K03"),
    _rule("TMP-008", HIGH, "Current loan was not delinquent this month", "loan_tape",
          "months_since_last_delinquency = 0 AND loan_status = 'CURRENT'", "K04"),
    _rule("TMP-009", MEDIUM, "Tradeline open date is plausible", "tradeline_report_application",
          "open_date > rep_report_date OR datediff(rep_report_date, open_date) / 365.25D > 50", "K03"),
    _rule("TMP-010", MEDIUM, "Vintage month is the origination month", "loan_tape",
          "vintage_month <> date_format(origination_date, 'yyyy-MM')", "K07"),

    _rule("FIN-001", CRITICAL, "Balance is within the original amount", "loan_tape",
          "current_principal_balance > original_loan_amount", "K07"),
    _rule("FIN-002", CRITICAL, "Payment parts add up to the cent", "payments",
          "abs(principal_paid + interest_paid - actual_payment_amount) > 0.01D", "K08"),
    _rule("FIN-003", MEDIUM, "Installment repays the loan", "loan_tape",
          f"abs(original_installment_amount - ({INSTALLMENT})) > 1.0D", "K30", below(0.01)),
    _rule("FIN-004", MEDIUM, "Interest fits balance and rate", "payment_vintage_month",
          "payment_status = 'POSTED' AND "
          "abs(interest_paid - beginning_principal_balance * original_interest_rate / 12) > 5.0D", "K08", below(0.05)),
    _rule("FIN-005", HIGH, "Principal paid lowers the balance", "payments",
          "abs(ending_principal_balance - (beginning_principal_balance - principal_paid)) > 0.10D", "K08"),
    _rule("FIN-006", MEDIUM, "Percentage rate is just above interest rate", "loan_tape",
          "original_apr < original_interest_rate OR original_apr - original_interest_rate > 0.05D", "K07",
          below(0.01)),
    _rule("FIN-007", HIGH, "Origination fee is at most 6%", "loan_tape",
          "origination_fee > original_loan_amount * 0.06D", "K07"),
    _rule("FIN-008", LOW, "Disbursed amount is amount less fee", "loan_tape",
          "abs(disbursed_amount - (original_loan_amount - origination_fee)) > 1", "K08", below(0.10)),
    _rule("FIN-009", MEDIUM, "Payoff amount is the sum of balances", "loan_tape",
          "payoff_amount > 0 AND abs(payoff_amount - (current_principal_balance + current_interest_balance "
          "+ current_fees_balance)) > 10", "K08", below(0.05)),
    _rule("FIN-010", HIGH, "Balance of an open loan does not grow", "loan_steps",
          "loan_status NOT IN ('CHARGED_OFF', 'PAID_OFF') "
          "AND current_principal_balance > prev_current_principal_balance", "K15", below(0.01)),

    _rule("LOG-001", CRITICAL, "Status fits days past due", "loan_tape",
          "(loan_status = 'CURRENT' AND days_past_due <> 0) OR "
          "(loan_status = 'DELINQUENT_30' AND days_past_due < 30)", "K04"),
    _rule("LOG-002", HIGH, "Delinquent flag fits days past due", "loan_tape",
          "(delinquent_flag = TRUE AND days_past_due = 0) OR (delinquent_flag = FALSE AND days_past_due > 0)", "K04"),
    _rule("LOG-003", CRITICAL, "Revolving trades are within all trades", "credit_reports",
          "revolving_trades_count > all_trades_count", "K07"),
    _rule("LOG-004", HIGH, "Bucket flags fit days past due", "loan_tape",
          "(delinquent_0_30_flag = TRUE AND NOT (days_past_due BETWEEN 1 AND 30)) OR "
          "(delinquent_31_60_flag = TRUE AND NOT (days_past_due BETWEEN 31 AND 60)) OR "
          "(delinquent_61_90_flag = TRUE AND NOT (days_past_due BETWEEN 61 AND 90)) OR "
          "(delinquent_91_120_flag = TRUE AND NOT (days_past_due BETWEEN 91 AND 120))", "K05"),
    _rule("LOG-005", HIGH, "Worst days past due is the worst", "loan_tape",
          "worst_days_past_due < days_past_due", "K07"),
    _rule("LOG-006", HIGH, "Delinquency counts fall with depth", "loan_tape",
          "times_60_dpd > times_30_dpd OR times_90_dpd > times_60_dpd", "K07"),
    _rule("LOG-007", MEDIUM, "History string holds the delinquencies", "loan_tape",
          "length(loan_payment_history) > 0 AND times_30_dpd <> "
          "(length(loan_payment_history) - length(replace(loan_payment_history, '01', ''))) / 2", "K35", below(0.10)),
    _rule("LOG-008", MEDIUM, "Scores of application and report agree", "report_application",
          "abs(app_fico_score_at_application - fico_score_8) > 20", "K22", below(0.05)),
    _rule("LOG-009", MEDIUM, "Utilization is plausible", "credit_reports",
          "revolving_utilization_ratio > 1.5D OR revolving_utilization_ratio < 0", "K05", below(0.01)),
    _rule("LOG-010", LOW, "Trade types add up", "credit_reports",
          "abs(all_trades_count - (revolving_trades_count + installment_trades_count + mortgage_trades_count)) > 3",
          "K08", below(0.10)),
    _rule("LOG-011", MEDIUM, "Bankruptcy lowers the score", "credit_reports",
          "bankruptcies_count > 0 AND fico_score_8 > 650", "K04", below(0.05)),
    _rule("LOG-012", MEDIUM, "Months on book are plausible", "loan_tape", "months_on_book > 100", "K07"),
    _rule("LOG-013", HIGH, "Never-paid loan has no posted payment", "snapshot_with_posted",
          "never_paid_flag = TRUE", "K32",
          count=summed("loan_ledger", "CASE WHEN posted > 0 AND loan_id IS NOT NULL THEN never_paid END")),
    _rule("LOG-014", LOW, "Address failed verification", "fraud_application", "address_verified = FALSE", "K22",
          INFORMATION),
    _rule("LOG-015", MEDIUM, "Number was issued after birth", "fraud_application",
          "ssn_issued_start_year < year(app_date_of_birth)", "K03", below(0.01)),

    _rule("STAT-001", LOW, "Score histogram", "applications", "fico_score_at_application IS NULL", "K24", INFORMATION),
    _rule("STAT-002", LOW, "Approval rate", "applications", "decision_status = 'APPROVED'", "K23", band(60, 80)),
    _rule("STAT-003", MEDIUM, "Roll rate 30 to 60 days", "vintage_rolls",
          "count_30 > 100 AND NOT (roll_30_to_60 BETWEEN 20 AND 50)", "K26",
          columns=("count_30", "roll_30_to_60")),
    _rule("STAT-004", MEDIUM, "Charge-off rate of mature loans", "loan_tape",
          "months_on_book >= 12 AND chargeoff_flag = 1", "K26", band(3, 10),
          base=Base("loan_tape", "months_on_book >= 12")),
    _rule("STAT-005", LOW, "Debt ratio histogram", "applications",
          "decision_status = 'APPROVED' AND debt_to_income_ratio IS NULL", "K24", INFORMATION),
    _rule("STAT-006", LOW, "Income by state", "applications", "annual_income IS NULL", "K24", INFORMATION),
    _rule("STAT-007", MEDIUM, "Inquiries lower the score", "inquiry_trend", "correlation >= 0", "K25",
          columns=("correlation",)),
    _rule("STAT-008", MEDIUM, "Utilization lowers the score", "utilization_trend", "correlation >= 0", "K25",
          columns=("correlation",)),
    _rule("STAT-009", LOW, "Prepayment curve", "loan_tape", "loan_status = 'PAID_OFF'", "K26", INFORMATION,
          base=Base("loan_tape", "loan_status IN ('CURRENT', 'PAID_OFF')")),
    _rule("STAT-010", LOW, "Grade shares", "loan_tape", "grade IS NULL", "K24", INFORMATION),

    _rule("DQ-001", CRITICAL, "Application score is in range", "applications",
          "NOT (fico_score_at_application BETWEEN 300 AND 850)", "K05"),
    _rule("DQ-002", CRITICAL, "Income is positive", "applications", "annual_income <= 0", "K04"),
    _rule("DQ-003", CRITICAL, "Declared columns are present", "schema_differences", "gap = 'MISSING'", "K33",
          columns=("gap",)),
    _rule("DQ-004", MEDIUM, "Null rates are acceptable", "null_rates",
          "(critical AND null_pct > 0) OR (NOT critical AND null_pct >= 90)", "K27",
          columns=("critical", "null_pct")),
    _rule("DQ-005", HIGH, "Last digits have four characters", "applications",
          "octet_length(ssn_last4) <> 4 OR ssn_last4 = '0000'", "K09"),
    _rule("DQ-006", LOW, "Email is well formed", "applications",
          "email_address IS NOT NULL AND NOT email_address RLIKE "
          "'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Z|a-z]{2,}$'", "K09", below(0.01)),
    _rule("DQ-007", LOW, "Phone is ddd-ddd-dddd", "applications",
          "phone_primary IS NOT NULL AND NOT phone_primary RLIKE '^[0-9]{3}-[0-9]{3}-[0-9]{4}$'", "K09"),
    _rule("DQ-008", MEDIUM, "Zip code has five characters", "applications",
          "octet_length(address_zip) <> 5 OR address_zip = '00000'", "K09"),
    _rule("DQ-009", MEDIUM, "State code is known", "applications", f"address_state NOT IN {STATES}", "K06"),
    _rule("DQ-010", HIGH, "Dates are plausible", "applications",
          "application_date < DATE '2020-01-01' OR application_date > {as_of} OR "
          "date_of_birth < DATE '1920-01-01' OR date_of_birth > add_months({as_of}, -216)", "K05"),
    _rule("DQ-011", CRITICAL, "Balances are not negative", "loan_tape",
          "current_principal_balance < 0 OR current_interest_balance < 0 OR current_fees_balance < 0", "K04"),
    _rule("DQ-012", MEDIUM, "Identity occurs once", "identity_keys", "copies > 1", "K29", below(0.001),
          base=Base("applications")),

    _rule("HYD-001", MEDIUM, "Delinquent borrower has delinquencies on file", "report_loan",
          "loan_status LIKE '%DELINQUENT%' AND delinquency_30_day_count = 0", "K22", below(0.10)),
    _rule("HYD-002", HIGH, "Cured loan knows its last delinquency", "loan_tape",
          "loan_status = 'CURRENT' AND times_30_dpd > 0 AND "
          "(months_since_last_delinquency IS NULL OR months_since_last_delinquency = 999)", "K10"),
    _rule("HYD-003", MEDIUM, "Some tradelines were late", "credit_tradelines",
          "times_30dpd = 0 AND times_60dpd = 0 AND times_90dpd = 0", "K23", below(0.90)),
    _rule("HYD-004", LOW, "Fraud scores vary", "fraud_score_spread",
          "NOT (stddev > 100 AND mean BETWEEN 600 AND 800)", "K31", columns=("stddev", "mean")),
    _rule("HYD-005", LOW, "Bank transactions are numerous", "bank_volume", "total_rows <= 1000", "K20",
          columns=("total_rows",)),
    _rule("HYD-006", HIGH, "Loan and application name one customer", "loan_application",
          "customer_id <> app_customer_id", "K22"),
    _rule("HYD-007", LOW, "Some payments wait in suspense", "payments",
          "suspense_amount = 0 AND unapplied_amount = 0", "K23", below(0.99)),
    _rule("HYD-008", MEDIUM, "Autopay share", "payments", "autopay_flag = TRUE", "K23", band(60, 80)),
    _rule("HYD-009", LOW, "Payment channel mix", "payments", "payment_channel IS NULL", "K24", INFORMATION),
    _rule("HYD-010", MEDIUM, "Returned payment share", "payments",
          "nsf_flag = TRUE OR returned_flag = TRUE", "K23", band(1, 3)),
    _rule("HYD-011", MEDIUM, "Subgrade starts with the grade", "loan_tape",
          "substring(subgrade, 1, 1) <> grade", "K07"),
    _rule("HYD-012", LOW, "Bureau mix", "credit_reports", "bureau_code IS NULL", "K24", INFORMATION),
))

#: Forms of the written catalogue where they differ from the coded rule.
CATALOGUE_SPEC = Pack("catalogue_spec", (
    _rule("INT-006", HIGH, "Every application has one fraud check", "fraud_cardinality", "children <> 1", "K21",
          variant="spec", columns=("children",),
          count=summed("application_ledger", "CASE WHEN apps > 0 AND (checks <> 1 OR application_id IS NULL) THEN 1 END")),
    _rule("INT-008", HIGH, "Application, loan and payment name one customer", "customer_triple",
          "app_customer_id <> customer_id OR customer_id <> pay_customer_id", "K22", variant="spec"),
    _rule("TMP-010", MEDIUM, "Vintage month and year are those of origination", "loan_tape",
          "vintage_month <> date_format(origination_date, 'yyyy-MM') OR vintage_year <> year(origination_date)",
          "K07", variant="spec"),
    _rule("FIN-004", MEDIUM, "Interest fits balance and rate in the snapshot month", "payment_snapshot_month",
          "payment_status = 'POSTED' AND "
          "abs(interest_paid - beginning_principal_balance * original_interest_rate / 12) > 5.0D", "K08",
          below(0.05), variant="snapshot"),
    _rule("LOG-006", HIGH, "Delinquency counts fall with depth, to 120 days", "loan_tape",
          "times_60_dpd > times_30_dpd OR times_90_dpd > times_60_dpd OR times_120_dpd > times_90_dpd", "K07",
          variant="spec"),
    _rule("LOG-012", MEDIUM, "Months on book are the month difference", "loan_tape",
          f"months_on_book <> {MONTH_GAP}", "K07", variant="spec"),
    _rule("STAT-003", MEDIUM, "Roll rate 60 to 90 days", "vintage_rolls",
          "count_60 > 100 AND NOT (roll_60_to_90 BETWEEN 50 AND 70)", "K26", variant="spec",
          columns=("count_60", "roll_60_to_90")),
    _rule("STAT-004", MEDIUM, "Charge-off rate by vintage", "vintage_chargeoffs",
          "NOT (chargeoff_rate BETWEEN 3 AND 10)", "K26", variant="spec", columns=("chargeoff_rate",)),
    _rule("DQ-005", HIGH, "Last digits are four digits", "applications",
          "NOT ssn_last4 RLIKE '^[0-9]{4}$' OR ssn_last4 = '0000'", "K09", variant="spec"),
    _rule("DQ-008", MEDIUM, "Zip code is five digits", "applications",
          "NOT address_zip RLIKE '^[0-9]{5}$' OR address_zip = '00000'", "K09", variant="spec"),
))

#: Rules of the checklists and reports.
CHECKS = Pack("checks", (
    _rule("CHK-001", MEDIUM, "Share of loans 30 days past due", "loan_tape", "days_past_due >= 30", "K23", band(2, 8)),
    _rule("CHK-004", LOW, "Extreme scores, ages and incomes", "applications",
          f"fico_score_at_application < 500 OR fico_score_at_application > 800 OR {AGE} > 100 "
          "OR annual_income > 500000", "K24", INFORMATION),
    _rule("CHK-005", MEDIUM, "Derived columns follow their source", "loan_tape",
          "(vintage_month IS NULL OR months_on_book IS NULL) AND origination_date IS NOT NULL", "K10"),
    _rule("CHK-008", HIGH, "Charge-off flag needs 120 days past due", "loan_tape",
          "chargeoff_flag = 1 AND days_past_due < 120", "K04"),
    _rule("CHK-009", MEDIUM, "Trade partitions fit their total", "credit_reports",
          "bankcard_trades_count + installment_trades_count + revolving_trades_count > all_trades_count "
          "OR bankcard_trades_open_count > bankcard_trades_count "
          "OR installment_trades_open_count > installment_trades_count "
          "OR revolving_trades_open_count > revolving_trades_count", "K07"),
    _rule("CHK-010", HIGH, "Delinquency depth has missed payments", "snapshot_missed_depth",
          "missed_count < CASE loan_status WHEN 'DELINQUENT_30' THEN 1 WHEN 'DELINQUENT_60' THEN 2 "
          "WHEN 'DELINQUENT_90' THEN 3 ELSE 4 END", "K17", columns=("missed_count",)),
    _rule("CHK-011", MEDIUM, "Loan has payments", "loan_without_payment", "TRUE", "K02", distinct="loan_id",
          count=summed("loan_ledger", "CASE WHEN snapshots > 0 AND (payments = 0 OR loan_id IS NULL) THEN 1 END")),
    Rule("GEN-003", "Terminal states are final", "loan_steps",
         "prev_loan_status IN ('PAID_OFF', 'CHARGED_OFF') AND loan_status <> prev_loan_status", "K14",
         category="Generation", distinct="loan_id"),
    Rule("GEN-001", "Approved score is at least 640", "applications",
         "decision_status = 'APPROVED' AND fico_score_at_application < 640", "K04", category="Generation"),
    Rule("GEN-002", "Loan belongs to an application", "loan_orphan", "TRUE", "K01", category="Generation",
         count=orphan_count("snapshots")),
))
