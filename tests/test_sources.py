"""Loading, schemas, writing, sampling."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanward.sources import schemas as sc
from loanward.sources.tables import (
    Tables, add_aliases, load_tables, sample_tables, table_stats, typed_nulls, write_month_partitioned, write_table)


def test_absent_files_are_left_out(spark, lending, tmp_path):
    write_table(lending["applications"], str(tmp_path), "applications")
    tables = load_tables(spark, str(tmp_path), as_of=dt.date(2024, 6, 30))
    assert list(tables) == ["applications"] and tables.as_of == dt.date(2024, 6, 30)
    assert tables.row_count("applications") == 1500
    assert table_stats(tables).collect() == [("applications", 1500, len(lending["applications"].columns))]


def test_month_partitions_prune(spark, lending, tmp_path):
    path = write_month_partitioned(lending["loan_tape"], str(tmp_path), "loan_tape", "snapshot_date")
    back = spark.read.parquet(path)
    assert back.count() == lending["loan_tape"].count()
    plan = back.filter("month = '2021-05'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_null_typed_columns_get_a_type(spark):
    df = spark.createDataFrame([(1,)], "x int").withColumn("application_id", F.lit(None))
    assert dict(typed_nulls(df).dtypes)["application_id"] == "string"
    assert dict(typed_nulls(df, {"application_id": T.LongType()}).dtypes)["application_id"] == "bigint"


def test_older_column_names_are_found(spark):
    df = spark.createDataFrame([(0.1, 2)], "interest_rate double, original_interest_rate int")
    assert add_aliases(df, "loan_tape").first().original_interest_rate == 2
    assert add_aliases(df.drop("original_interest_rate"), "loan_tape").first().original_interest_rate == 0.1


def test_declared_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("column_name,data_type\na_id,VARCHAR(20)\nn,INT\nx,\"DECIMAL(10,2)\"\nd,DATE\n")
    schema = sc.load_schema(spark, str(tmp_path / "t.csv"))
    assert schema.simpleString() == "struct<a_id:string,n:int,x:double,d:date>"
    (tmp_path / "data.csv").write_text("a_id,n,x,d\nq,1,2.5,2024-01-01\n")
    assert sc.read_csv(spark, str(tmp_path / "data.csv"), schema).first().d == dt.date(2024, 1, 1)


def test_sample_keeps_families_together(lending):
    part = sample_tables(lending, 0.3)
    apps = part["applications"].count()
    assert 0.2 * 1500 < apps < 0.4 * 1500
    keys = {r[0] for r in part["applications"].select("application_id").distinct().collect()}
    loans = part["loan_tape"].join(lending["applications"].select("application_id").distinct(), "application_id")
    assert {r[0] for r in loans.select("application_id").distinct().collect()} <= keys
    # Rows without a parent stay, so orphans are still found.
    def orphans(t):
        return t["payments"].join(t["loan_tape"], "loan_id", "left_anti").select("payment_id").distinct().count()
    assert orphans(part) == orphans(lending)


def test_empty_set_has_no_stats():
    with pytest.raises(ValueError):
        table_stats(Tables({}))


def test_shuffles_grow_with_the_rows(spark):
    """Partitions follow the rows of all tables and are never fewer than the session's."""
    from loanward.sources.tables import size_shuffles
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.minPartitionNum",
             "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        assert size_shuffles([spark.range(1000)]) == int(before[names[0]])
        assert {n: spark.conf.get(n, None) for n in names} == before
        assert size_shuffles([spark.range(1000), spark.range(501)], 100) == 16
        assert [spark.conf.get(n) for n in names] == ["16"] * 3
        assert size_shuffles([spark.range(10)], 100) == 16
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
