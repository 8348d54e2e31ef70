"""Pack results and reports in SQL."""

from oracle import rules as R

FOUNDATION_RANGES = ((1, 8, "Lifecycle"), (9, 16, "State Machine"), (17, 23, "Temporal"), (24, 30, "Financial"),
                     (31, 38, "Payment"), (39, 46, "Credit"), (47, 53, "Fraud"), (54, 60, "State"))

#: Rules of the catalogue judged by a rate, a trend or a profile: violations and status.
_BAND = ("SELECT '{id}' AS rule_id, CAST(CASE WHEN p BETWEEN {lo} AND {hi} THEN 0 ELSE 1 END AS BIGINT) AS violations, "
         "CASE WHEN p BETWEEN {lo} AND {hi} THEN 'PASS' ELSE 'WARN' END AS status FROM "
         "(SELECT count(*) FILTER (WHERE {hit}) * 100.0 / count(*) AS p FROM {rows})")
_ONE = ("SELECT '{id}' AS rule_id, CAST(v AS BIGINT) AS violations, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status "
        "FROM (SELECT {v} AS v FROM {rows})")
_INFO = "SELECT '{id}' AS rule_id, CAST(0 AS BIGINT) AS violations, 'INFO' AS status"
_EXTRA = [
    _BAND.format(id="STAT-002", lo=60, hi=80, hit="decision_status = 'APPROVED'", rows="applications"),
    _BAND.format(id="STAT-004", lo=3, hi=10, hit="chargeoff_flag = 1", rows="loan_tape WHERE months_on_book >= 12"),
    _BAND.format(id="HYD-008", lo=60, hi=80, hit="autopay_flag", rows="payments"),
    _BAND.format(id="HYD-010", lo=1, hi=3, hit="nsf_flag OR returned_flag", rows="payments"),
    _ONE.format(id="STAT-003", v="count(*)", rows=(
        "(SELECT count(*) FILTER (WHERE loan_status = 'DELINQUENT_30') AS a, count(*) FILTER (WHERE loan_status = 'DELINQUENT_60') AS b "
        "FROM loan_tape GROUP BY vintage_month) WHERE a > 100 AND b * 100.0 / a NOT BETWEEN 20 AND 50")),
    _ONE.format(id="STAT-007", v="CASE WHEN corr(inquiries_6mo_count, fico_score_8) >= 0 THEN 1 ELSE 0 END", rows="credit_reports"),
    _ONE.format(id="STAT-008", v="CASE WHEN corr(revolving_utilization_ratio, fico_score_8) >= 0 THEN 1 ELSE 0 END", rows="credit_reports"),
    _ONE.format(id="HYD-004", v="CASE WHEN stddev_samp(overall_fraud_score) > 100 AND avg(overall_fraud_score) BETWEEN 600 AND 800 THEN 0 ELSE 1 END", rows="fraud_verification"),
    _ONE.format(id="HYD-005", v="CASE WHEN count(*) <= 1000 THEN 1 ELSE 0 END", rows="bank_transactions"),
    _ONE.format(id="DQ-003", v="CASE WHEN count(*) < 0 THEN 1 ELSE 0 END", rows="applications"),
    _ONE.format(id="DQ-004", v=(
        "CASE WHEN count(loan_id) < count(*) THEN 1 ELSE 0 END + CASE WHEN (SELECT count(application_date) < count(*) FROM applications) THEN 1 ELSE 0 END "
        "+ CASE WHEN (count(*) - count(return_date)) * 100.0 / count(*) >= 90 THEN 1 ELSE 0 END"), rows="payments"),
    *[_INFO.format(id=i) for i in ("STAT-001", "STAT-005", "STAT-006", "STAT-009", "STAT-010", "HYD-009", "HYD-012")],
]


def pack_body(entries: dict, info: tuple = (), extra: list = ()) -> str:
    rows = []
    for rule_id, entry in entries.items():
        ok = R.STATUS.get(rule_id, "v = 0")
        status = "'INFO'" if rule_id in info else f"CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END"
        value = "CAST(0 AS BIGINT)" if rule_id in info else "v"
        rows.append(f"SELECT '{rule_id}' AS rule_id, {value} AS violations, {status} AS status FROM "
                    f"(SELECT CAST(coalesce(sum(violations), 0) AS BIGINT) AS v FROM ({R.offenders_body(entry)}))")
    return " UNION ALL ".join([*rows, *extra])


_F = f"({pack_body(R.FOUNDATION)})"
_C = f"({pack_body(R.CATALOGUE, ('LOG-014',), _EXTRA)})"
_CATEGORY = "CASE " + " ".join(f"WHEN n <= {hi} THEN '{name}'" for _, hi, name in FOUNDATION_RANGES) + " END"
#: Severities of the catalogue; the rest are LOW.
_SEVERITY = {
    "CRITICAL": (
        "INT-001", "INT-002", "INT-003", "INT-004", "INT-005", "POL-001", "POL-003", "POL-009", "TMP-001",
        "TMP-007", "FIN-001", "FIN-002", "LOG-001", "LOG-003", "DQ-001", "DQ-002", "DQ-003", "DQ-011",
    ),
    "HIGH": (
        "INT-006", "INT-008", "POL-002", "POL-005", "POL-010", "TMP-002", "TMP-003", "TMP-008", "FIN-005",
        "FIN-007", "FIN-010", "LOG-002", "LOG-004", "LOG-005", "LOG-006", "LOG-013", "DQ-005", "DQ-010", "HYD-002",
        "HYD-006",
    ),
    "MEDIUM": (
        "INT-007", "POL-004", "POL-006", "POL-007", "POL-008", "TMP-004", "TMP-006", "TMP-009", "TMP-010",
        "FIN-003", "FIN-004", "FIN-006", "FIN-009", "LOG-007", "LOG-008", "LOG-009", "LOG-011", "LOG-012",
        "LOG-015", "STAT-003", "STAT-004", "STAT-007", "STAT-008", "DQ-004", "DQ-008", "DQ-009", "DQ-012",
        "HYD-001", "HYD-003", "HYD-008", "HYD-010", "HYD-011",
    ),
}
_SEV = "CASE " + " ".join(
    f"WHEN rule_id IN ({', '.join(repr(i) for i in ids)}) THEN '{s}'" for s, ids in _SEVERITY.items()) + " ELSE 'LOW' END"

#: The second version of the data: loan rows with an unknown status and payments with an
#: amount on a missed row are taken out.
REPAIRED = {"loan_tape": "loan_status NOT IN ('FROZEN')",
            "payments": "NOT (payment_status = 'MISSED' AND actual_payment_amount > 0)"}


def _changed(views: dict[str, str], body: str = f"SELECT * FROM ({pack_body(R.FOUNDATION)})") -> str:
    """The body over views that stand in for those named; ``{name}_all`` is what they replace."""
    text = R.with_views(body)
    present = [n for n in R.VIEWS if f"{n} AS (" in text]
    for name in views:
        text = text.replace(f"{name} AS (", f"{name}_all AS (", 1)
    order = sorted((n for n in present if n in views), key=lambda n: n in ("payments", "credit_tradelines"))
    added = ", ".join(f"{n} AS ({views[n]})" for n in order)
    helpers = [text.index(f", {h} AS (") for h in R.HELPERS if f", {h} AS (" in text]
    first = min(helpers) if helpers else text.index(f") {body}") + 1
    return f"{text[:first]}, {added}{text[first:]}"


def _versions() -> str:
    before = R.with_views(f"SELECT * FROM ({pack_body(R.FOUNDATION)})")
    after = _changed({n: f"SELECT * FROM {n}_all WHERE {w}" for n, w in REPAIRED.items()})
    return (f"SELECT a.rule_id, a.status AS v1_status, a.violations AS v1_violations, b.status AS v2_status, b.violations AS v2_violations, "
            f"b.violations - a.violations AS delta, round((a.violations - b.violations) * 100.0 / nullif(a.violations, 0), 6) AS reduction_pct "
            f"FROM ({before}) a JOIN ({after}) b ON a.rule_id = b.rule_id")


#: The tenth of the data that the sampled run looks at: keys whose md5 is below the threshold; payments follow
#: their loan and tradelines their report, orphans stay.
_KEPT = "left(md5(CAST(application_id AS VARCHAR) || '|7'), 12) < '19999999999a'"


def _sampled(*body: str) -> str:
    views = {n: f"SELECT * FROM {n}_all WHERE {_KEPT}" for n in (
        "applications", "loan_tape", "credit_reports", "fraud_verification", "bank_transactions")}
    for child, parent, key in (("payments", "loan_tape", "loan_id"), ("credit_tradelines", "credit_reports", "credit_report_id")):
        views[child] = (f"SELECT * FROM {child}_all x WHERE NOT EXISTS (SELECT 1 FROM {parent}_all p WHERE p.{key} = x.{key}) "
                        f"OR EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = x.{key})")
    return _changed(views, *body)


#: Relative tolerances of the written variants; the others allow nothing.
_SPEC_STATUS = {
    ("FND-052", "spec"): "v < 0.01 * (SELECT count(*) FROM applications)",
    ("FIN-004", "snapshot"): ("v < 0.05 * (SELECT count(*) FROM payments p JOIN loan_tape l ON p.loan_id = l.loan_id "
                              "AND strftime(p.payment_due_date, '%Y-%m') = strftime(l.snapshot_date, '%Y-%m'))"),
}


def _specs() -> str:
    return " UNION ALL ".join(
        f"SELECT '{i}' AS rule_id, '{v}' AS variant, v AS violations, "
        f"CASE WHEN {_SPEC_STATUS.get((i, v), 'v = 0')} THEN 'PASS' ELSE 'FAIL' END AS status FROM "
        f"(SELECT CAST(coalesce(sum(violations), 0) AS BIGINT) AS v FROM ({R.offenders_body(e)}))"
        for (i, v), e in R.SPEC.items())


#: The 29 rules of the reduced selection.
_REDUCED = {f"FND-{n:03d}": R.FOUNDATION[f"FND-{n:03d}"] for n in (
    1, 2, 3, 4, 7, 9, 10, 12, 13, 16, 17, 19, 22, 23, 24, 25, 26, 29, 30, 31, 34, 36, 37, 39, 43, 47, 51, 54, 60)}

#: Sign-off: share of rows allowed to violate, against the rows a relative rule looks at.
_ALLOWED = {"HIGH": 0.01, "MEDIUM": 0.05}


def _sign_off() -> str:
    severity = {i: s for s, ids in _SEVERITY.items() for i in ids}
    relative = []
    for rule_id, test in R.STATUS.items():
        if severity.get(rule_id) in _ALLOWED and rule_id in R.CATALOGUE:
            rows = test.split(" * ", 1)[1]
            relative.append(f"WHEN rule_id = '{rule_id}' THEN violations * 1.0 / {rows} >= {_ALLOWED[severity[rule_id]]}")
    over = f"CASE WHEN violations = 0 THEN FALSE {' '.join(relative)} ELSE TRUE END"
    return (f"SELECT severity, count(*) AS rules, count(*) FILTER (WHERE over_) AS rules_over, "
            f"CASE WHEN count(*) FILTER (WHERE over_) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM "
            f"(SELECT {_SEV} AS severity, {over} AS over_ FROM {_C} WHERE status IN ('PASS', 'FAIL')) "
            f"WHERE severity <> 'LOW' GROUP BY 1")


#: What the skipped rules lack.
_ABSENT = {"RUN-037": "column interest_accrued not found", "RUN-038": "column interest_accrued not found",
           "RUN-053": "table bank_transactions not found"}


def _skipped() -> str:
    rest = pack_body({i: e for i, e in R.RUNNER.items() if i not in _ABSENT})
    rows = " UNION ALL ".join(f"SELECT '{i}' AS check_id, CAST(-1 AS BIGINT) AS violations, 'SKIP: {why}' AS status" for i, why in _ABSENT.items())
    return f"SELECT rule_id AS check_id, violations, status FROM ({rest}) UNION ALL {rows}"


def _saved_report() -> str:
    """Every foundation rule is critical; a tolerance is what the status compares with."""
    allowed = " ".join(f"WHEN rule_id = '{i}' THEN {test.split('= ' if '<=' in test else '< ', 1)[1]}"
                       for i, test in R.STATUS.items() if i in R.FOUNDATION)
    return (f"SELECT rule_id AS check_id, status, violations, CAST(CASE {allowed} ELSE 0 END AS DOUBLE) AS tolerance, "
            f"violations || ' violations' AS details, 'CRITICAL' AS severity, "
            f"CAST(max(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) OVER () AS BIGINT) AS exit_code FROM {_F}")


REPORTS = {
    "rp_02_skipped": R.with_views(_skipped()),
    "rp_09_saved_report": R.with_views(_saved_report()),
    "pack_reduced": R.with_views(pack_body(_REDUCED)),
    "rp_13_sign_off": R.with_views(_sign_off()),
    "pack_foundation": R.with_views(f"SELECT * FROM {_F}"),
    "pack_runner": R.with_views(pack_body(R.RUNNER)),
    "pack_catalogue": R.with_views(f"SELECT * FROM {_C}"),
    "pack_checks": R.with_views(pack_body(
        R.CHECKS, ("CHK-004",), [_BAND.format(id="CHK-001", lo=2, hi=8, hit="days_past_due >= 30", rows="loan_tape")])),
    "rp_05_totals": R.with_views(
        "SELECT count(*) AS total, count(*) AS evaluated, count(*) FILTER (WHERE status = 'PASS') AS passed, "
        "count(*) FILTER (WHERE status = 'FAIL') AS failed, CAST(0 AS BIGINT) AS skipped, "
        "CAST(sum(violations) FILTER (WHERE status = 'FAIL') AS BIGINT) AS violations, "
        f"round(count(*) FILTER (WHERE status = 'PASS') * 100.0 / count(*), 6) AS pass_rate FROM {_F}"),
    "rp_06_failed": R.with_views(f"SELECT rule_id, violations FROM {_F} WHERE status = 'FAIL'"),
    "rp_07_by_severity": R.with_views(f"SELECT {_SEV} AS severity, status, count(*) AS rules FROM {_C} GROUP BY 1, 2"),
    "rp_08_by_category": R.with_views(
        f"SELECT {_CATEGORY} AS category, count(*) AS evaluated, count(*) FILTER (WHERE status = 'PASS') AS passed, "
        f"round(count(*) FILTER (WHERE status = 'PASS') * 100.0 / count(*), 6) AS pass_rate FROM "
        f"(SELECT *, CAST(right(rule_id, 3) AS INTEGER) AS n FROM {_F}) GROUP BY 1"),
    "rp_11_examples": R.with_views(
        "SELECT credit_report_id, application_id, open_trades_count, all_trades_count, open_trades_count - all_trades_count AS excess "
        "FROM credit_reports WHERE open_trades_count > all_trades_count ORDER BY excess DESC, credit_report_id LIMIT 10"),
    "rp_12_versions": _versions(),
    "rp_14_sampled_run": _sampled(),
    "pack_specs": R.with_views(_specs()),
}
