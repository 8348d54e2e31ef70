"""Every rule is silent on clean data and fires for its own fault."""

import pytest

from loanward.plans.evaluate import evaluate, offenders
from loanward.plans.packs import ALL_PACKS
from tests import families

#: Rules that judge whole tables; their own tests are in test_rules.py.
WHOLE_TABLE = {"FND-011", "FND-059", "RUN-057", "RUN-058", "RUN-059", "DQ-003", "DQ-004", "DQ-012", "HYD-003", "HYD-004",
               "HYD-005", "HYD-007", "HYD-008", "HYD-009", "HYD-010", "HYD-012", "LOG-014", "CHK-001", "CHK-004",
               "FIN-004", "FIN-004/snapshot", "RUN-011/distinct", "GEN-003"}


def _key(row):
    return row.rule_id if row.variant == "code" or row.rule_id == "FND-053" else f"{row.rule_id}/{row.variant}"


def _all(tables):
    return {_key(r): r for p in ALL_PACKS.values() for r in evaluate(p, tables).collect()}


@pytest.fixture(scope="module")
def results(spark):
    return _all(families.clean(spark)), _all(families.faulty(spark))


def test_clean_families_violate_nothing(results):
    judged = {k: r for k, r in results[0].items() if k not in WHOLE_TABLE and not k.startswith("STAT-")}
    assert {k: r.matching for k, r in judged.items() if r.matching} == {}
    assert {k for k, r in judged.items() if r.status not in ("PASS", "INFO")} == set()


def test_every_fault_fires(results):
    silent = [(rule, fault[1:]) for fault in families.FAULTS for rule in fault[0].split()
              if not results[1][rule].matching]
    assert silent == []


def test_every_rule_has_a_fault(results):
    covered = {rule for fault in families.FAULTS for rule in fault[0].split()}
    assert {k for k in results[0] if not k.startswith("STAT-")} - covered - WHOLE_TABLE == set()


#: One fault per way of finding violations, with the key that must be named.
NAMED = [("FND-001", "loan_id", "L"), ("FND-005", "loan_id", "L"), ("FND-009", "payment_id", "P"),
         ("FND-054", "loan_id", "L"), ("FND-060", "application_id", "A"), ("FND-017", "credit_report_id", "R"),
         ("FND-046", "tradeline_id", "T"), ("FND-047", "application_id", "A")]


@pytest.mark.parametrize("rule_id, column, prefix", NAMED)
def test_the_faulty_family_is_named(spark, rule_id, column, prefix):
    pack = ALL_PACKS["foundation"]
    found = {r[0] for r in offenders(pack.rule(rule_id), families.faulty(spark)).select(column).collect()}
    planted = [k + 1 for k, f in enumerate(families.FAULTS) if rule_id in f[0].split()]
    keys = {k.split("-")[0] for k in found}
    assert {"A0" if rule_id == "FND-060" else f"{prefix}{n}" for n in planted} <= keys
    assert f"{prefix}0" not in keys or rule_id == "FND-060"
