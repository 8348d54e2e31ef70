"""All oracle statements by query name."""

from __future__ import annotations

from loanward.plans.bindings import STAR_TABLES
from oracle import rules as R
from oracle.delimited import DELIMITED
from oracle.drilldown import DRILLDOWN
from oracle.estimates import ESTIMATES
from oracle.footers import FOOTERS
from oracle.kinds import KINDS
from oracle.layout import LAYOUT
from oracle.measures import MEASURES
from oracle.preparations import PREPARATIONS
from oracle.profiles import PROFILES
from oracle.quantiles import QUANTILES
from oracle.reports import REPORTS
from oracle.sieve import SIEVE

_COLUMNS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
            "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


def _key(rule_id: str, variant: str = "") -> str:
    return rule_id.lower().replace("-", "_") + (f"_{variant}" if variant else "")


def all_oracles() -> dict[str, str]:
    out = {"io_02_table_stats": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({_COLUMNS[t]} AS BIGINT) AS column_count FROM {t}"
        for t in STAR_TABLES)}
    out.update(FOOTERS)
    out.update(DELIMITED)
    out.update(LAYOUT)
    out.update(QUANTILES)
    out.update(SIEVE)
    out.update(KINDS)
    for group in (R.FOUNDATION, R.RUNNER, R.CATALOGUE, R.CHECKS):
        out.update({_key(i): R.offenders_sql(e) for i, e in group.items()})
    out.update({_key(i, v): R.offenders_sql(e) for (i, v), e in R.SPEC.items()})
    out.update({_key(k) + ("_profile" if k.startswith("CHK") else ""): v for k, v in PROFILES.items()})
    out.update(REPORTS)
    out.update(MEASURES)
    out.update(DRILLDOWN)
    out.update(ESTIMATES)
    out.update(PREPARATIONS)
    return out
