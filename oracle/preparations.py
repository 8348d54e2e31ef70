"""Preparation queries in SQL."""

from oracle.rules import AS_OF, with_views

_N = "CAST(regexp_extract(application_id, '([0-9]+)$', 1) AS BIGINT)"
_FUNDED = f"(SELECT *, {_N} AS n FROM applications WHERE decision_status = 'APPROVED' AND {_N} % 100 < 90)"
_RATE = ("least(greatest(CAST(0.15 AS DOUBLE) + (750 - fico_score_at_application) * CAST({p} AS DOUBLE) "
         "+ debt_to_income_ratio * CAST(0.1 AS DOUBLE), CAST(0.06 AS DOUBLE)), CAST(0.25 AS DOUBLE))")
_RATE_OR_NULL = "CASE WHEN debt_to_income_ratio IS NOT NULL THEN " + _RATE + " END"
_TERM = "CASE WHEN n % 100 < 10 THEN 24 WHEN n % 100 < 40 THEN 36 WHEN n % 100 < 75 THEN 48 ELSE 60 END"
_AMOUNT = "least(greatest(annual_income * CAST(0.15 AS DOUBLE), 1000), 50000)"
_LOANS = "(SELECT loan_id, min(origination_date) AS od, max(original_installment_amount) AS amt FROM loan_tape GROUP BY 1)"
_SPINE = (f"(SELECT loan_id, od, amt, last_day(CAST(m AS DATE)) AS me FROM (SELECT *, "
          f"unnest(generate_series(date_trunc('month', od), date_trunc('month', {AS_OF}), INTERVAL 1 MONTH)) AS m FROM {_LOANS}))")
_MONTHS = "((year(me) - year(od)) * 12 + month(me) - month(od))"
_APPROVED = "coalesce(decision_status = 'APPROVED', FALSE)"
_TERMS = ("(SELECT loan_id, min(origination_date) AS od, max(original_term_months) AS term, "
          "max(original_installment_amount) AS inst, min(snapshot_date) FILTER (WHERE loan_status = 'CHARGED_OFF') AS co, "
          "max(snapshot_date) FILTER (WHERE loan_status = 'PAID_OFF') AS po, "
          "min(snapshot_date) FILTER (WHERE loan_status = 'PREPAID') AS pp FROM loan_tape GROUP BY 1)")
_AS_OF_MONTHS = f"((year({AS_OF}) - year(od)) * 12 + month({AS_OF}) - month(od))"
_SCHEDULE = (
    f"(SELECT loan_id, CASE WHEN po IS NOT NULL AND due = last_day(po) THEN 'PAYOFF' ELSE 'REGULAR' END AS payment_type, "
    f"due, inst AS amount FROM (SELECT *, last_day(CAST(od + to_months(CAST(k AS INTEGER)) AS DATE)) AS due FROM "
    f"(SELECT *, unnest(generate_series(1, least(term, {_AS_OF_MONTHS}))) AS k FROM {_TERMS})) "
    f"WHERE pp IS NULL AND (coalesce(co, po) IS NULL OR due <= last_day(least(coalesce(co, po), coalesce(po, co)))) "
    f"UNION ALL SELECT loan_id, 'PREPAYMENT', pp, inst * term FROM {_TERMS} WHERE pp IS NOT NULL)")
_ROLLS = ("(SELECT * FROM steps WHERE loan_status IN ('DELINQUENT_30', 'DELINQUENT_60', 'DELINQUENT_90') "
          "AND loan_status IS DISTINCT FROM p_loan_status)")
_SNAPS = ("(SELECT loan_id, snapshot_date, max(current_principal_balance) AS b, max(original_interest_rate) AS r "
          "FROM loan_tape GROUP BY 1, 2)")
_PAYOFF = "payment_type IS NOT NULL AND payment_type = 'PAYOFF'"
_INTEREST = (f"CASE WHEN {_PAYOFF} THEN 0.0 WHEN actual_payment_amount <= 0 THEN 0.0 "
             "ELSE least(actual_payment_amount, interest_accrued) END")

_BODY = {
    "pr_01_normalise_applications":
        f"SELECT application_id, upper(lower(decision_status)) AS decision_status, CASE {_N} % 3 WHEN 0 THEN 'ONLINE' "
        f"WHEN 1 THEN 'PARTNER' ELSE 'DIRECT' END AS channel, product_type FROM applications",
    "pr_02_funded_population": f"SELECT application_id, customer_id FROM {_FUNDED}",
    "pr_03_risk_rate":
        f"SELECT application_id, round({_RATE_OR_NULL.format(p='0.0001')}, 8) AS rate, "
        f"round({_RATE_OR_NULL.format(p='0.001')}, 8) AS steep_rate FROM {_FUNDED}",
    "pr_04_loan_amount":
        f"SELECT application_id, {_AMOUNT} AS amount, "
        f"least(greatest(annual_income, 20000), 90000) AS income_capped FROM {_FUNDED}",
    "pr_05_installment":
        f"SELECT application_id, original_term_months, round(CASE WHEN rate IS NULL THEN NULL ELSE "
        f"amt * (rate / 12) * pow(1 + rate / 12, original_term_months) / (pow(1 + rate / 12, original_term_months) - 1) END, 6) AS installment, "
        f"amt / original_term_months AS straight_line FROM (SELECT application_id, {_TERM} AS original_term_months, "
        f"{_AMOUNT} AS amt, {_RATE_OR_NULL.format(p='0.0001')} AS rate FROM {_FUNDED})",
    "pr_06_month_spine":
        f"SELECT loan_id, count(*) AS months, CAST(min(me) AS VARCHAR) AS first_month, CAST(max(me) AS VARCHAR) AS last_month FROM {_SPINE} GROUP BY 1",
    "pr_07_months_on_book":
        "SELECT loan_id, CAST(sum(least(greatest(m, 1), 60)) AS BIGINT) AS on_book, CAST(sum(m) AS BIGINT) AS apart FROM "
        "(SELECT loan_id, datediff('month', origination_date, snapshot_date) AS m FROM loan_tape) GROUP BY 1",
    "pr_08_expected_schedule":
        f"SELECT loan_id, payment_type, count(*) AS payments, CAST(min(due) AS VARCHAR) AS first_due, "
        f"CAST(max(due) AS VARCHAR) AS last_due, round(sum(amount), 2) AS scheduled FROM {_SCHEDULE} GROUP BY 1, 2",
    "pr_09_missed_payments":
        f"SELECT 'PMT-' || loan_id || '-' || months_on_book || '-MISSED' || CASE loan_status WHEN 'DELINQUENT_60' THEN '60' "
        f"WHEN 'DELINQUENT_90' THEN '90' ELSE '' END AS payment_id, loan_id, CAST(snapshot_date AS VARCHAR) AS payment_due_date, "
        f"'MISSED' AS payment_status, CAST(0 AS DOUBLE) AS actual_payment_amount, "
        f"current_principal_balance * (original_interest_rate / 12) AS interest_accrued FROM {_ROLLS}",
    "pr_09_backfilled_payments":
        f"SELECT payment_status, count(*) AS payments FROM (SELECT payment_status FROM payments UNION ALL SELECT 'MISSED' FROM {_ROLLS}) GROUP BY 1",
    "pr_10_payment_waterfall":
        f"SELECT payment_id, round({_INTEREST}, 6) AS interest_paid, "
        f"round(greatest(actual_payment_amount, 0) - ({_INTEREST}), 6) AS principal_paid FROM payments",
    "pr_11_interest_accrued":
        f"SELECT payment_id, round(b * (r / 12), 6) AS interest_accrued FROM payments p LEFT JOIN {_SNAPS} s "
        f"ON p.loan_id = s.loan_id AND p.snapshot_date = s.snapshot_date",
    "pr_11_interest_daily":
        f"SELECT payment_id, round(round(b * (r / 365) * 30, 2), 1) AS interest_accrued FROM payments p JOIN {_SNAPS} s "
        f"ON p.loan_id = s.loan_id AND p.snapshot_date = s.snapshot_date",
    "pr_12_status_columns":
        "SELECT ['CURRENT', 'DELINQUENT_30', 'DELINQUENT_60', 'DELINQUENT_90', 'CHARGED_OFF', 'PAID_OFF'][c + 1] AS loan_status, "
        "CAST([0, 30, 60, 90, 120, 0][c + 1] AS INTEGER) AS days_past_due, CAST(c = 4 AS INTEGER) AS chargeoff_flag, "
        "CAST(c >= 3 AS INTEGER) AS default_flag, count(*) AS row_count FROM "
        "(SELECT CAST(substr(loan_id, 4) AS BIGINT) % 6 AS c FROM loan_tape) GROUP BY c",
    "pr_13_vintage_columns":
        "SELECT strftime(origination_date, '%Y-%m') AS vintage_month, year(origination_date) || '-Q' || quarter(origination_date) AS vintage_quarter, "
        "CAST(year(origination_date) AS INTEGER) AS vintage_year, count(*) AS row_count FROM loan_tape GROUP BY 1, 2, 3",
    "pr_14_terminal_once":
        "SELECT loan_id, count(*) AS snapshots FROM steps WHERE NOT (loan_status = 'PAID_OFF' AND coalesce(p_loan_status, '') = 'PAID_OFF') "
        "AND NOT (loan_status = 'CHARGED_OFF' AND current_principal_balance = 0 AND days_past_due > 120) GROUP BY 1",
    "pr_15_natural_payoff":
        "SELECT CASE WHEN low THEN 'PAID_OFF' ELSE loan_status END AS loan_status, count(*) AS row_count, "
        "round(sum(CASE WHEN low THEN 0 ELSE current_principal_balance END), 2) AS balance FROM "
        "(SELECT *, loan_status = 'CURRENT' AND current_principal_balance < 2000 AS low FROM loan_tape) GROUP BY 1",
    "pr_16_projected_balances":
        f"SELECT loan_id, round(min(bal), 6) AS lowest_balance, round(max(bal), 6) AS highest_balance FROM "
        f"(SELECT loan_id, amt * pow(CAST(0.97 AS DOUBLE), least(greatest({_MONTHS}, 1), 60)) AS bal FROM {_SPINE}) GROUP BY 1",
    "pr_17_credit_snapshot":
        "SELECT 'CR-' || application_id AS credit_report_id, CAST(floor(fico_score_8 * CAST(0.9 AS DOUBLE) + 50) AS INTEGER) AS vantage_score_3, "
        "all_trades_count AS revolving_trades_count FROM credit_reports",
    "pr_18_tradelines":
        "SELECT credit_report_id || '-TL1' AS tradeline_id, 'MORTGAGE' AS account_type, CAST(250000 AS DOUBLE) AS current_balance, "
        "CAST(300000 AS DOUBLE) AS credit_limit, CAST(1500 AS DOUBLE) AS monthly_payment, CAST(report_date - 1825 AS VARCHAR) AS open_date "
        "FROM credit_reports WHERE fico_score_8 > 680 UNION ALL SELECT credit_report_id || '-TL2', 'REVOLVING', round(lim * u, 4), round(lim, 4), "
        "round(greatest(25, lim * u * CAST(0.02 AS DOUBLE)), 4), CAST(report_date - 730 AS VARCHAR) FROM "
        "(SELECT *, CAST(5000 + (fico_score_8 - 600) * 50 AS DOUBLE) AS lim, revolving_utilization_ratio AS u FROM credit_reports)",
    "pr_19_identity_score":
        f"SELECT application_id, CAST(CASE WHEN decision_status = 'APPROVED' THEN 70 + {_N} % 26 ELSE 10 + {_N} % 51 END AS INTEGER) AS score FROM applications",
    "pr_20_fraud_check_status":
        "SELECT application_id, fraud_risk_score, CASE WHEN fraud_risk_score > 600 THEN 'FAILED' WHEN fraud_risk_score < 400 AND decision_status = 'APPROVED' "
        "THEN 'PASSED' ELSE 'FLAGGED' END AS fraud_check_status FROM checked",
    "pr_21_weighted_columns":
        f"SELECT application_id, CASE WHEN n % 100 < 70 THEN 'VERIFIED' WHEN n % 100 < 90 THEN 'UNVERIFIED' ELSE 'PENDING' END AS income_verification_status, "
        f"CASE WHEN n % 100 < 65 THEN 'VERIFIED' WHEN n % 100 < 90 THEN 'UNVERIFIED' ELSE 'PENDING' END AS employment_verification_status, "
        f"CAST(CASE WHEN {_APPROVED} AND fico_score_at_application > 700 THEN 1 + n % 3 WHEN NOT {_APPROVED} AND fico_score_at_application < 650 "
        f"THEN 5 + n % 11 ELSE 2 + n % 6 END AS INTEGER) AS inquiries, {_TERM} AS term FROM (SELECT *, {_N} AS n FROM applications)",
    "pr_22_funding_date":
        f"SELECT application_id, CAST(decision_date + CAST(1 + {_N} % 7 AS INTEGER) AS VARCHAR) AS funding_date FROM applications WHERE decision_status = 'APPROVED'",
    "pr_23_complete_schema":
        "SELECT credit_report_id, application_id, fico_score_8, all_trades_count, "
        "CAST(trunc(all_trades_count * (CAST(0.6 AS DOUBLE) + CAST(0.0003 AS DOUBLE) * (CAST(substr(credit_report_id, 4) AS BIGINT) % 1000))) AS INTEGER) AS open_trades_count, "
        "CAST(trunc(all_trades_count * CAST(0.3 AS DOUBLE)) AS INTEGER) AS mortgage_trades_count, 0 AS delinquency_30_day_count, "
        "1 AS inquiries_6mo_count, 0 AS collections_count, CAST(0 AS DOUBLE) AS total_balance_amount, revolving_utilization_ratio, "
        "CAST(NULL AS DATE) AS update_date, FALSE AS freeze_flag, 'Y' AS name_match_flag, CAST(NULL AS VARCHAR) AS bureau_name, 0 AS segment, "
        "CAST(NULL AS VARCHAR) AS external_id, CAST(NULL AS VARCHAR) AS bureau_code FROM credit_reports",
    "pr_24_project_schema":
        "SELECT credit_report_id, application_id, fico_score_8, all_trades_count, open_trades_count, mortgage_trades_count, "
        "delinquency_30_day_count, inquiries_6mo_count, revolving_utilization_ratio, bureau_code FROM credit_reports",
    "pr_25_reference_codes":
        "SELECT DISTINCT 'PRODUCT_TYPE' AS code_type, product_type AS code_value, product_type || ' Loan' AS description, 'Lending' AS parent_code_value FROM applications "
        "UNION ALL SELECT DISTINCT 'CHANNEL', channel, channel || ' Channel', 'Direct' FROM applications "
        "UNION ALL SELECT DISTINCT 'STATE', state, state, 'US' FROM applications "
        "UNION ALL SELECT 'DECISION_STATUS', 'APPROVED', 'Application Approved', 'Review Complete' "
        "UNION ALL SELECT 'DECISION_STATUS', 'DECLINED', 'Application Declined', 'Review Complete'",
    "pr_26_constants_and_names":
        "SELECT account_type AS kind, account_status, 12 AS months_reviewed, count(*) AS row_count FROM credit_tradelines GROUP BY 1, 2",
    "pr_27_delinquency_counts":
        "SELECT credit_report_id, CAST(coalesce(d30, CASE WHEN fico_score_8 > 720 THEN 0 WHEN fico_score_8 > 660 THEN 1 ELSE 2 END) AS INTEGER) AS delinquency_30_day_count, "
        "CAST(coalesce(d60, 0) AS INTEGER) AS delinquency_60_day_count, CAST(coalesce(d90, 0) AS INTEGER) AS delinquency_90_day_count FROM credit_reports c LEFT JOIN "
        "(SELECT application_id AS a, count(*) FILTER (WHERE days_past_due >= 30) AS d30, count(*) FILTER (WHERE days_past_due >= 60) AS d60, "
        "count(*) FILTER (WHERE days_past_due >= 90) AS d90 FROM loan_tape GROUP BY 1) ON a = c.application_id",
}

PREPARATIONS = {k: with_views(v) for k, v in _BODY.items()}
