"""Preparation of the loan tape and of payments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanward.functions import dates
from loanward.functions.finance import daily_interest, declining_balance, monthly_interest
from loanward.operators import anchors as an
from loanward.operators.skew import skew_join, unfold, with_previous

#: State codes, their labels and days past due.
STATES = ((0, "CURRENT", 0), (1, "DELINQUENT_30", 30), (2, "DELINQUENT_60", 60), (3, "DELINQUENT_90", 90),
          (4, "CHARGED_OFF", 120), (5, "PAID_OFF", 0))


def month_spine(loans: DataFrame, as_of: dt.date, start: str = "origination_date") -> DataFrame:
    """One row per loan and month end, from origination to the as-of month."""
    ends = dates.month_ends(start, F.lit(as_of))
    return (loans.withColumn("snapshot_date", F.explode(ends))
            .withColumn("months_on_book", dates.months_on_book("snapshot_date", start).cast("int")))


def status_columns(code: Column | str) -> dict[str, Column]:
    """Label, days past due and flags of a state code."""
    c = F.col(code) if isinstance(code, str) else code
    label = dpd = None
    for value, name, days in STATES:
        test = c == value
        label = F.when(test, name) if label is None else label.when(test, name)
        dpd = F.when(test, days) if dpd is None else dpd.when(test, days)
    return {"loan_status": label, "days_past_due": dpd,
            "chargeoff_flag": (c == 4).cast("int"), "default_flag": c.between(3, 5).cast("int")}


def vintage_columns(date: str = "origination_date") -> dict[str, Column]:
    return {"vintage_month": dates.vintage_month(date), "vintage_quarter": dates.vintage_quarter(date),
            "vintage_year": F.year(date)}


def projected_balances(spine: DataFrame, amount: str = "original_loan_amount") -> DataFrame:
    """Balance of every spine month when 3% of it is repaid each month."""
    return spine.withColumn("current_principal_balance", declining_balance(amount, "months_on_book"))


def natural_payoff(panel: DataFrame, below: float = 10.0) -> DataFrame:
    """A current loan with a balance under the limit is paid off."""
    done = (F.col("loan_status") == "CURRENT") & (F.col("current_principal_balance") < below)
    return panel.withColumns({
        "loan_status": F.when(done, "PAID_OFF").otherwise(F.col("loan_status")),
        "current_principal_balance": F.when(done, 0.0).otherwise(F.col("current_principal_balance"))})


_PANEL_ORDER = ("snapshot_date", "months_on_book", "days_past_due", "current_principal_balance", "loan_status")


def _stepped(panel: DataFrame, hot: Sequence) -> DataFrame:
    values = [c for c in _PANEL_ORDER if c in panel.columns]
    return with_previous(panel, "loan_id", ["snapshot_date"], values, hot)


def terminal_once(panel: DataFrame, hot: Sequence = ()) -> DataFrame:
    """Report payoff once, and stop reporting emptied charge-offs past 120 days."""
    steps = _stepped(panel, hot)
    repeated = (F.col("loan_status") == "PAID_OFF") & (F.col("prev_loan_status") == "PAID_OFF")
    emptied = ((F.col("loan_status") == "CHARGED_OFF") & (F.col("current_principal_balance") == 0)
               & (F.col("days_past_due") > 120))
    kept = steps.filter(~F.coalesce(repeated | emptied, F.lit(False)))
    # A folded copy stands for _n rows.
    return unfold(kept.select(*panel.columns, "_n"))


def missed_payments(panel: DataFrame, hot: Sequence = (), rate: str = "original_interest_rate") -> DataFrame:
    """A missed payment for every snapshot at which a loan rolls to 30, 60 or 90 days."""
    depth = F.regexp_extract("loan_status", "([0-9]+)$", 1)
    rolled = _stepped(panel, hot).filter(
        F.col("loan_status").isin("DELINQUENT_30", "DELINQUENT_60", "DELINQUENT_90")
        & ~F.col("loan_status").eqNullSafe(F.col("prev_loan_status")))
    zero = F.lit(0.0)
    label = F.concat(F.lit("MISSED"), F.when(depth == "30", "").otherwise(depth))
    return rolled.select(
        F.concat_ws("-", F.lit("PMT"), "loan_id", F.col("months_on_book").cast("string"), label).alias("payment_id"),
        "loan_id", F.col("snapshot_date").alias("payment_due_date"),
        F.col("snapshot_date").alias("payment_received_date"),
        F.col("original_installment_amount").alias("scheduled_payment_amount"),
        zero.alias("actual_payment_amount"), zero.alias("principal_paid"), zero.alias("interest_paid"),
        monthly_interest("current_principal_balance", rate).alias("interest_accrued"),
        F.lit("MISSED").alias("payment_status"), F.lit(False).alias("autopay_flag"),
        F.lit("NONE").alias("payment_method"), F.lit("NONE").alias("payment_channel"))


def backfill_missed(payments: DataFrame, panel: DataFrame, hot: Sequence = ()) -> DataFrame:
    """Payments with the missed ones added."""
    return payments.unionByName(missed_payments(panel, hot), allowMissingColumns=True)


def loan_terms(panel: DataFrame) -> DataFrame:
    """One row per loan: terms and the dates at which its schedule ends."""
    return an.anchors(panel, "loan_id", {
        "origination_date": F.min("origination_date"),
        "original_term_months": F.max("original_term_months"),
        "original_installment_amount": F.max("original_installment_amount"),
        "chargeoff_date": an.min_where("snapshot_date", "loan_status = 'CHARGED_OFF'"),
        "payoff_date": an.max_where("snapshot_date", "loan_status = 'PAID_OFF'"),
        "prepaid_date": an.min_where("snapshot_date", "loan_status = 'PREPAID'")})


def expected_schedule(panel: DataFrame, as_of: dt.date) -> DataFrame:
    """Monthly payments every loan should have had by the as-of date.

    Payments stop at charge-off and run through payoff, whose last one is marked; a
    prepaid loan has the single payment of its prepayment date.
    """
    terms = loan_terms(panel)
    as_of_col = F.lit(as_of)
    months = F.greatest(F.least(
        F.col("original_term_months"), dates.months_apart(as_of_col, "origination_date")), F.lit(0))
    numbers = F.when(months > 0, F.sequence(F.lit(1), months.cast("int"))).otherwise(F.array().cast("array<int>"))
    due = terms.withColumn("payment_number", F.explode(numbers)).withColumn(
        "payment_due_date", F.last_day(F.expr("add_months(origination_date, payment_number)")))
    last = F.least("chargeoff_date", "payoff_date")
    regular = due.filter("prepaid_date IS NULL").filter(
        last.isNull() | (F.col("payment_due_date") <= F.last_day(last)))
    final = F.col("payoff_date").isNotNull() & (F.col("payment_due_date") == F.last_day("payoff_date"))
    cols = ["loan_id", "payment_number", "payment_due_date",
            F.col("original_installment_amount").alias("scheduled_payment_amount")]
    regular = regular.select(*cols, F.when(final, "PAYOFF").otherwise("REGULAR").alias("payment_type"))
    prepaid = terms.filter("prepaid_date IS NOT NULL").select(
        "loan_id", F.lit(1).alias("payment_number"), F.col("prepaid_date").alias("payment_due_date"),
        (F.col("original_installment_amount") * F.col("original_term_months")).alias("scheduled_payment_amount"),
        F.lit("PREPAYMENT").alias("payment_type"))
    return regular.unionByName(prepaid)


def waterfall(paid: Column | str, accrued: Column | str, payoff: Column | None = None) -> dict[str, Column]:
    """Split a payment: interest first, the rest to principal; a payoff is all principal."""
    p = F.col(paid) if isinstance(paid, str) else paid
    a = F.col(accrued) if isinstance(accrued, str) else accrued
    to_interest = F.when(p <= 0, F.lit(0.0)).otherwise(F.least(p, a))
    if payoff is not None:
        to_interest = F.when(payoff, F.lit(0.0)).otherwise(to_interest)
    return {"interest_paid": to_interest, "principal_paid": F.greatest(p, F.lit(0.0)) - to_interest}


def with_interest_accrued(payments: DataFrame, panel: DataFrame, hot: Sequence = (), daily: int | None = None) -> DataFrame:
    """Interest due at each payment, from the snapshot of the same loan and date.

    Snapshots are reduced to one per loan and date (largest balance), so a payment stays
    one row.  ``daily`` counts that many days at rate/365 instead of a month at rate/12.
    """
    snaps = panel.groupBy("loan_id", "snapshot_date").agg(
        F.max("current_principal_balance").alias("_balance"), F.max("original_interest_rate").alias("_rate"))
    amount = monthly_interest("_balance", "_rate") if daily is None else F.round(
        daily_interest("_balance", "_rate", daily), 2)
    return (skew_join(payments, snaps, ["loan_id", "snapshot_date"], "left", hot)
            .withColumn("interest_accrued", amount).drop("_balance", "_rate"))


def due_as_snapshot(payments: DataFrame) -> DataFrame:
    return payments.withColumn("snapshot_date", F.col("payment_due_date"))


def delinquency_counts(reports: DataFrame, panel: DataFrame, hot: Sequence = ()) -> DataFrame:
    """Delinquency counts of a report from the loan history, else from the score band."""
    history = an.anchors(panel, "application_id", {
        f"_d{d}": an.count_where(f"days_past_due >= {d}") for d in (30, 60, 90)})
    score = F.col("fico_score_8")
    fallback = F.when(score > 720, 0).when(score > 660, 1).otherwise(2)
    base = reports.drop(*[f"delinquency_{d}_day_count" for d in (30, 60, 90)])
    out = skew_join(base, history, "application_id", "left", hot)
    return out.withColumns({
        "delinquency_30_day_count": F.coalesce("_d30", fallback).cast("int"),
        "delinquency_60_day_count": F.coalesce("_d60", F.lit(0)).cast("int"),
        "delinquency_90_day_count": F.coalesce("_d90", F.lit(0)).cast("int")}).drop("_d30", "_d60", "_d90")
