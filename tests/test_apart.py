"""Reports whose parts are jobs of their own: the same rows, and no shuffle files that outlive their part."""

import os
import time

import pytest

from loanward.plans.drilldown import worst_offenders
from loanward.plans.evaluate import CLEAN_SHUFFLES, evaluate
from loanward.plans.packs import FOUNDATION, RUNNER
from loanward.plans.packs.runner import RUNNER_EXCESS
from loanward.plans.queries import all_queries


def _shuffled(spark) -> dict[str, int]:
    """Shuffle files on disk with their bytes."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    paths = []
    while files.hasNext():
        paths.append(files.next().getPath())
    return {p: os.path.getsize(p) for p in paths if os.path.basename(p).startswith("shuffle_") and os.path.exists(p)}


def _left_behind(spark, before: dict[str, int], most: int) -> int:
    """Bytes of newer shuffle files, once their removal has had its time."""
    for _ in range(50):
        left = sum(size for path, size in _shuffled(spark).items() if path not in before)
        if left < most:
            break
        time.sleep(0.2)
    return left


@pytest.mark.parametrize("name", ["rp_12_versions", "rp_11_worst_of_pack"])
def test_a_report_leaves_no_shuffles_of_its_parts(spark, small, name):
    before = _shuffled(spark)
    frame = all_queries()[name](spark, small)
    assert frame.count() >= 60
    assert _left_behind(spark, before, 200_000) < 200_000


def test_relations_measured_apart_give_the_same_results(spark, lending):
    rules = [r for r in FOUNDATION if r.relation in ("payment_marks", "loan_totals", "loan_steps", "applications", "fraud_parity")]
    settings = spark.conf.get(CLEAN_SHUFFLES, None)
    assert sorted(map(tuple, evaluate(rules, lending, apart=True).collect())) == sorted(map(tuple, evaluate(rules, lending).collect()))
    assert spark.conf.get(CLEAN_SHUFFLES, None) == settings
    assert evaluate([], lending, apart=True).collect() == []


def test_passes_ranked_apart_give_the_same_offenders(lending):
    rules = [*RUNNER.select(("RUN-001", "RUN-023", "RUN-037", "RUN-043", "RUN-058")), RUNNER.rule("RUN-043")]
    once, apart = (worst_offenders(rules, lending, RUNNER_EXCESS, apart=a) for a in (False, True))
    assert once.schema == apart.schema and sorted(map(str, once.collect())) == sorted(map(str, apart.collect()))
    assert worst_offenders([], lending, apart=True).collect() == []
