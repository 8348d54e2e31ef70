"""A spread of named queries against DuckDB; tests/compare.py runs them all."""

import pytest

import __spark_entry__ as entry
from loanward.plans.queries import all_queries
from oracle.catalog import all_oracles
from tests.compare import connect, difference

PICKED = ["io_02_table_stats", "k02_conditional_existence", "k14_terminal_state", "k16_sequence_gap", "k22_cross_table_value",
          "k27_null_profile", "k33_schema_exhaustiveness", "fnd_009", "fnd_021", "fnd_032", "fnd_055", "run_023",
          "int_001", "int_008_spec", "fin_003", "fin_004", "hyd_001", "chk_010", "stat_006", "dq_004", "pack_foundation",
          "pack_runner", "rp_12_versions", "pr_08_expected_schedule", "pr_14_terminal_once", "pr_23_complete_schema"]


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_oracle(spark, small, duck, name):
    assert difference(entry.queries()[name](spark, small), duck, entry.oracle_sql()[name]) is None


def test_every_query_has_its_sql():
    """Of this part of the library; the training-data operators hold their own list."""
    assert set(all_oracles()) == set(all_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 60
