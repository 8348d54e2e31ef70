"""Existence behind a filter of keys against plain joins."""

import pytest
from pyspark.sql import functions as F

from loanward.operators import sieve
from loanward.operators.sieve import key_words, may_hold, sieved_holders, sieved_orphans


@pytest.fixture(scope="module")
def child(spark):
    return spark.range(20_000).selectExpr("if(id % 50 = 0, NULL, concat('k', id % 4000)) AS k", "id % 300 AS v").persist()


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("count", [0, 1, 200, 4000])
def test_rows_are_those_of_plain_joins(spark, child, count):
    parents = spark.range(count).selectExpr("if(id = 7, NULL, concat('k', id)) AS k", "1 AS v")
    parents = parents.unionByName(parents)
    assert _rows(sieved_holders(child, parents, "k")) == _rows(child.join(parents, "k", "left_semi"))
    assert _rows(sieved_orphans(child, parents, "k")) == _rows(child.join(parents, "k", "left_anti"))
    assert sieved_holders(child.limit(0), parents, "k").collect() == []


def test_few_strangers_reach_the_exchange(spark, child):
    parents = spark.range(200).selectExpr("concat('k', id) AS k")
    passed, true = child.where(may_hold(parents, "k")).count(), child.join(parents, "k", "left_semi").count()
    assert true <= passed < true + 0.06 * child.count()
    plan = sieved_holders(child, parents, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_words_are_bounded_and_too_many_keys_take_the_plain_join(spark, child, monkeypatch):
    parents = spark.range(500).selectExpr("concat('k', id) AS k")
    assert len(key_words(parents, "k", 1 << 12).first().words) == 64
    monkeypatch.setattr(sieve, "MOST_BITS", 1 << 10)
    assert _rows(sieved_holders(child, parents, "k")) == _rows(child.join(parents, "k", "left_semi"))
    monkeypatch.setattr(sieve, "MOST_KEYS", 400)
    assert may_hold(parents, "k") is None
    assert _rows(sieved_orphans(child, parents, "k")) == _rows(child.join(parents, "k", "left_anti"))


def test_keys_of_numbers(spark):
    child = spark.range(1000).select(F.col("id").alias("k"))
    assert sieved_holders(child, child.where("k % 10 = 0"), "k").count() == 100
