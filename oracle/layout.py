"""Relations over bucketed tables, in SQL."""

from oracle import rules as R

_LEDGER = """
SELECT loan_id, CAST(sum(snapshots) AS BIGINT) AS snapshots, CAST(sum(delinquent) AS BIGINT) AS delinquent,
  CAST(sum(never_paid) AS BIGINT) AS never_paid, CAST(sum(payments) AS BIGINT) AS payments, CAST(sum(missed) AS BIGINT) AS missed,
  CAST(sum(posted) AS BIGINT) AS posted FROM (
  SELECT loan_id, 1 AS snapshots, CASE WHEN loan_status LIKE '%DELINQUENT%' THEN 1 ELSE 0 END AS delinquent,
    CASE WHEN never_paid_flag THEN 1 ELSE 0 END AS never_paid, 0 AS payments, 0 AS missed, 0 AS posted FROM loan_tape
  UNION ALL
  SELECT loan_id, 0, 0, 0, 1, CASE WHEN payment_status = 'MISSED' THEN 1 ELSE 0 END,
    CASE WHEN payment_status = 'POSTED' AND actual_payment_amount > 0 THEN 1 ELSE 0 END FROM payments)
GROUP BY loan_id
"""

_STEPS = """
SELECT loan_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, loan_status, p_loan_status AS prev_loan_status,
  p_current_principal_balance AS prev_current_principal_balance, count(*) AS copies FROM steps GROUP BY ALL
"""

LAYOUT = {"io_04_bucketed_ledger": R.with_views(_LEDGER), "io_04_bucketed_steps": R.with_views(_STEPS)}
