"""How the marks of loans are placed, and how joins of sized shuffles run."""

import datetime as dt
import re

from pyspark.sql import functions as F

from loanward.plans.relations import RELATIONS, loan_marks
from loanward.sources.tables import Tables, size_shuffles


def test_marks_are_made_distinct_where_payments_look_for_them(lending):
    plan = RELATIONS["payment_marks"].build(lending)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(loan_id#\d+, side#\d+, mark#", plan)


def test_the_tape_moves_once_for_the_marks_of_a_loan(lending):
    """Statuses and attributes are folded and made marks where their loan is, and payments go there."""
    plan = RELATIONS["payment_marks"].build(lending)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(loan_id#\d+, [a-z_]+#", plan)


def test_a_loan_has_each_mark_once(spark):
    day = dt.date(2020, 1, 1)
    rows = [("a", day, day, 5.0, "CURRENT"), ("a", day, day, 5.0, "CHARGED_OFF"), ("a", day, day, 5.0, None),
            ("b", day, None, 5.0, "CHARGED_OFF"), (None, day, day, 5.0, "CURRENT"), (None, day, day, 5.0, "CURRENT")]
    loans = spark.createDataFrame(rows, "loan_id string, origination_date date, first_payment_due_date date, "
                                        "original_loan_amount double, loan_status string")
    payments = spark.createDataFrame([("a",)], "loan_id string")
    marks = loan_marks(Tables({"loan_tape": loans, "payments": payments}))
    found = sorted((r.loan_id or "", r.side, r.mark, r.mark_status or "") for r in marks.collect())
    every = [("payment", "first_due", ""), ("payment", "origination", ""), ("total", "amount", ""), ("total", "origination", "")]
    opened = [("total", "open_origination", "")]
    own = {"a": every + opened + [("payment", "status", s) for s in ("", "CHARGED_OFF", "CURRENT")],
           "b": every + [("payment", "status", "CHARGED_OFF")], "": every + opened + [("payment", "status", "CURRENT")]}
    assert found == sorted((loan, *mark) for loan, marks in own.items() for mark in marks)


def test_joins_of_sized_partitions_are_hashed(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    size_shuffles([session.range(100)], 5)
    joined = session.range(100).join(session.range(50).withColumn("x", F.lit(1)), "id")
    assert len(joined.collect()) == 50
    assert "ShuffledHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
