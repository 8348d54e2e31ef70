"""The worst offenders of every runner rule in SQL."""

from oracle import rules as R

#: How far a row is beyond its bound, by rule.
_EXCESS = {
    12: "days_past_due", 13: "current_principal_balance", 14: "120 - days_past_due", 24: "0 - current_principal_balance",
    26: "current_principal_balance - original_loan_amount",
    28: "greatest(CAST(0.01 AS DOUBLE) - original_interest_rate, original_interest_rate - CAST(0.40 AS DOUBLE))",
    29: "abs(principal_paid + interest_paid - actual_payment_amount)", 32: "0 - original_loan_amount", 34: "actual_payment_amount",
    36: "abs(actual_payment_amount - scheduled_payment_amount_calc)", 37: "interest_paid - interest_accrued",
    38: "interest_accrued - interest_paid", 42: "trades_currently_past_due_count - all_trades_count",
    43: "open_trades_count - all_trades_count", 44: "greatest(0 - revolving_utilization_ratio, revolving_utilization_ratio - 2)",
    47: "greatest(0 - identity_verification_score, identity_verification_score - 100)",
    48: "greatest(0 - fraud_risk_score, fraud_risk_score - 999)",
}


def _rows(rule_id: str, entry: tuple) -> str:
    keys, rest = entry[0], entry[1]
    names = [R._name(k) for k in keys.removeprefix("D ").split(", ")]
    who = " || ', ' || ".join(f"'{n}=' || coalesce(CAST({n} AS VARCHAR), 'null')" for n in names)
    excess = _EXCESS.get(int(rule_id[-3:]))
    if excess:
        body = f"SELECT {keys}, max({excess}) AS e, count(*) AS violations {rest} GROUP BY {keys}"
    else:
        body = f"SELECT *, CAST(NULL AS DOUBLE) AS e FROM ({R.offenders_body(entry)})"
    return (f"SELECT '{rule_id}' AS rule_id, {who} AS who, round(CAST(e AS DOUBLE), 6) AS excess, "
            f"CAST(violations AS BIGINT) AS violations FROM ({body}) WHERE violations > 0")


_ALL = " UNION ALL ".join(_rows(i, e) for i, e in R.RUNNER.items())
DRILLDOWN = {"rp_11_worst_of_pack": R.with_views(
    f"SELECT * FROM (SELECT rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY excess DESC NULLS LAST, violations DESC, who) AS place, "
    f"who, excess, violations FROM ({_ALL})) WHERE place <= 10")}
