"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loanward.plans.queries import all_queries  # noqa: E402
from loanward.session import build_session  # noqa: E402

HEADLINE = (
    "io_02_table_stats", "pack_foundation", "pack_runner", "pack_catalogue", "pack_checks",
    "fnd_001", "fnd_009", "fnd_054", "fnd_056", "int_008_spec", "fin_003", "chk_010", "stat_006", "dq_004",
    "k03_joined_predicate", "k08_reconciliation", "k15_monotonic_measure", "k22_cross_table_value",
    "k26_cohort_rate", "k29_duplicate_groups", "k35_token_count",
    "pr_06_month_spine", "pr_08_expected_schedule", "pr_09_missed_payments", "pr_11_interest_accrued",
    "pr_23_complete_schema", "rp_05_totals", "rp_11_examples",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "loanward-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # Load classes and compile once, so that the first query is not charged for it.
    queries["k04_row_predicate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
