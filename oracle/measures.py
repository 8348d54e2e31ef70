"""Rules on payment rows, judged while writing and from merged months, in SQL."""

from oracle import rules as R
from oracle.reports import _BAND, _INFO, pack_body

#: Rules that look at single payments.
_IDS = {f"FND-{n:03d}" for n in (25, 29, 31, 33, 34, 35, 36, 37, 38)} | {
    f"RUN-{n:03d}" for n in (17, 19, 25, 29, 34, 35, 36, 37, 38)} | {"TMP-005", "FIN-002", "FIN-005", "HYD-007"}
_PACK = pack_body({i: e for group in (R.FOUNDATION, R.RUNNER, R.CATALOGUE) for i, e in group.items() if i in _IDS}, (), [
    _BAND.format(id="HYD-008", lo=60, hi=80, hit="autopay_flag", rows="payments"),
    _BAND.format(id="HYD-010", lo=1, hi=3, hit="nsf_flag OR returned_flag", rows="payments"), _INFO.format(id="HYD-009")])


def _late() -> str:
    """The rules over payments whose second half of 2023 holds no returned ones."""
    kept = "NOT (payment_due_date >= DATE '2023-07-01' AND payment_due_date < DATE '2024-01-01' AND returned_flag)"
    text = R.with_views(f"SELECT * FROM (WITH payments AS (SELECT * FROM payments_all WHERE {kept}) {_PACK})")
    return text.replace("payments AS (", "payments_all AS (", 1)


MEASURES = {"rp_02_judged_write": R.with_views(_PACK), "rp_12_late_months": _late()}
