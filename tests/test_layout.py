"""Tables in buckets: the same relations, and no exchange."""

import uuid

import pytest
from pyspark.sql import functions as F

from loanward.plans.relations import RELATIONS
from loanward.sources.layout import bucket_count, open_bucketed, write_bucketed
from loanward.sources.tables import Tables

KEYS = {"loan_tape": "loan_id", "payments": "loan_id"}


@pytest.fixture(scope="module")
def source(lending):
    """Loan tape and payments with some null keys and one key with a tenth of all rows."""
    def moved(df):
        turn = F.pmod(F.xxhash64(*df.columns), F.lit(10))
        return df.withColumn("loan_id", F.when(turn == 0, "HOT").when(turn == 1, None).otherwise(F.col("loan_id"))).limit(4000).cache()

    return {n: moved(lending[n]) for n in KEYS}


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("hot_min_rows", [100, 2_000_000])
def test_bucketed_relations_equal_plain_ones(spark, lending, source, tmp_path, hot_min_rows):
    tables = Tables(source, hot_min_rows=hot_min_rows)
    assert set(tables.hot("payments", "loan_id")) == ({"HOT", None} if hot_min_rows == 100 else set())
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    write_bucketed(tables, folder, KEYS, 8, {"loan_tape": ["snapshot_date"]})
    layout = open_bucketed(spark, folder, KEYS, 8, hot_min_rows=hot_min_rows)
    assert layout.aside["payments"].count() == (tables["payments"].where("loan_id IS NULL OR loan_id = 'HOT'").count() if hot_min_rows == 100 else 0)
    for name in ("loan_ledger", "loan_steps"):
        relation = RELATIONS[name]
        plain, got = relation.build(tables), layout.relation(relation)
        if name == "loan_steps":  # a row stands for _n equal ones, folded or not
            plain, got = (df.groupBy(*[c for c in df.columns if c != "_n"]).agg(F.sum("_n").alias("_n")) for df in (plain, got))
        assert _rows(got) == _rows(plain)
        plan = relation.build(layout.bucketed)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan
        assert "Exchange hashpartitioning" in relation.build(lending)._jdf.queryExecution().executedPlan().toString()
    files = spark.read.parquet(f"{folder}/payments_by_loan_id").select(F.input_file_name()).distinct().count()
    assert files <= 8  # one file for each bucket


def test_buckets_grow_with_the_largest_table(source):
    """Four times the rows of a bucket give four buckets, and a small table keeps the least number."""
    tables = Tables(source)
    rows = max(tables.row_count(n) for n in KEYS)
    assert bucket_count(tables, KEYS, least=1, rows_per_bucket=-(-rows // 4)) == 4
    assert bucket_count(tables, KEYS) == 8
