"""Violations of all rows from a tenth of the families in SQL."""

import re

from oracle import rules as R
from oracle.reports import _sampled

_FAMILY = {
    "payments": "(SELECT min(l.application_id) FROM loan_tape l WHERE l.loan_id = payments.loan_id)",
    "credit_tradelines": "(SELECT min(c.application_id) FROM credit_reports c WHERE c.credit_report_id = credit_tradelines.credit_report_id)",
}
#: Relative tolerances of these rules: share, least number, and the rows that the share is of.
_SHARES = {
    "FND-014": (0.05, 0, "TRUE"), "FND-033": (0.01, 0, "TRUE"), "FND-035": (0.20, 0, "TRUE"),
    "FND-038": (0.10, 1, "autopay_flag AND payment_status IN ('RETURNED', 'REVERSED')"), "FND-042": (0.001, 0, "TRUE"),
    "FND-044": (0.05, 0, "TRUE"), "FND-052": (0.01, 1, "email_address IS NOT NULL"), "FND-053": (0.01, 0, "TRUE"),
}
_TABLES = "applications|loan_tape|payments|credit_reports|credit_tradelines|fraud_verification"


def _families(rule_id: str, rest: str) -> str | None:
    m = re.fullmatch(rf"FROM ({_TABLES}) WHERE (.*)", rest)
    if not m:
        return None
    share, least, where = _SHARES.get(rule_id, (0, 0, "FALSE"))
    return (f"SELECT '{rule_id}' AS rule_id, {_FAMILY.get(m[1], 'application_id')} AS family, CAST(count(*) FILTER (WHERE {m[2]}) AS DOUBLE) AS y, "
            f"CAST(count(*) FILTER (WHERE {where}) AS DOUBLE) AS b, CAST({share} AS DOUBLE) AS share, {least} AS least FROM {m[1]} GROUP BY 2")


_PARTS = [f for f in (_families(i, e[1]) for i, e in R.FOUNDATION.items()) if f]
#: Families that a tenth misses with a probability of 5 %: log(0.05) / log(0.9).
_NONE = 29
_SUMS = (f"SELECT rule_id, share, least, CAST(sum(y) AS BIGINT) AS sampled, sum(CASE WHEN family IS NULL THEN y ELSE y * 10 END) AS estimate, "
         f"sqrt(sum(CASE WHEN family IS NULL THEN 0 ELSE 0.9::DOUBLE * y * y END)) * 10 AS d, "
         f"sum(CASE WHEN family IS NULL THEN y - share * b ELSE (y - share * b) * 10 END) AS o, "
         f"sqrt(sum(CASE WHEN family IS NULL THEN 0 ELSE 0.9::DOUBLE * (y - share * b) * (y - share * b) END)) * 10 AS od "
         f"FROM ({' UNION ALL '.join(_PARTS)}) GROUP BY 1, 2, 3")
_BODY = (f"SELECT rule_id, sampled, round(estimate, 4) AS estimate, round(low, 4) AS low, round(high, 4) AS high, "
         f"CASE WHEN share = 0 THEN CASE WHEN low > 0 THEN 'FAIL' WHEN high <= 0 THEN 'PASS' ELSE 'OPEN' END "
         f"WHEN rule_id = 'FND-053' THEN CASE WHEN o + 1.96::DOUBLE * od < 0 THEN 'PASS' WHEN o - 1.96::DOUBLE * od >= 0 THEN 'FAIL' ELSE 'OPEN' END "
         f"WHEN high <= least OR o + 1.96::DOUBLE * od <= 0 THEN 'PASS' WHEN low > least AND o - 1.96::DOUBLE * od > 0 THEN 'FAIL' ELSE 'OPEN' END AS status "
         f"FROM (SELECT *, greatest(sampled, estimate - 1.96::DOUBLE * d) AS low, CASE WHEN sampled = 0 THEN {_NONE} ELSE estimate + 1.96::DOUBLE * d END AS high "
         f"FROM ({_SUMS}))")
ESTIMATES = {"rp_14_estimates": _sampled(_BODY)}
