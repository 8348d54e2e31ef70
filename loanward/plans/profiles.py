"""Profiles of the lending tables: the distributions, rates and cohorts behind the
informational rules.  Each is a small result frame computed with one shuffle of
map-side combined groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.functions.dates import age_years
from loanward.operators import keys as ks
from loanward.operators import profile as pf
from loanward.operators.skew import skew_join
from loanward.plans.relations import RELATIONS
from loanward.sources.tables import Tables

PROFILES: dict[str, Callable[[Tables], DataFrame]] = {}


def profile(name: str):
    def register(build):
        PROFILES[name] = build
        return build
    return register


@profile("STAT-001")
def score_histogram(t: Tables) -> DataFrame:
    return pf.histogram(t["applications"], pf.bucketed("fico_score_at_application", 50))


@profile("STAT-002")
def decision_shares(t: Tables) -> DataFrame:
    return pf.shares(t["applications"], "decision_status")


@profile("STAT-003")
def roll_rates(t: Tables) -> DataFrame:
    return RELATIONS["vintage_rolls"].build(t)


@profile("STAT-004")
def chargeoff_by_vintage(t: Tables) -> DataFrame:
    return RELATIONS["vintage_chargeoffs"].build(t)


@profile("STAT-005")
def debt_ratio_histogram(t: Tables) -> DataFrame:
    return pf.histogram(t["applications"], F.floor(F.col("debt_to_income_ratio") * 10) * 10,
                        "dti_bucket", "decision_status = 'APPROVED'")


@profile("STAT-006")
def income_by_state(t: Tables) -> DataFrame:
    """Mean and exact median income per state."""
    apps = t["applications"]
    mean = apps.groupBy("address_state").agg(F.avg("annual_income").alias("avg_income"))
    median = pf.exact_median(apps, ["address_state"], "annual_income", "median_income")
    median = median.withColumnRenamed("address_state", "_state")  # the null state has a mean and a median too
    return mean.join(median, F.col("address_state").eqNullSafe(F.col("_state")), "left").drop("_state")


@profile("STAT-007")
def score_by_inquiries(t: Tables) -> DataFrame:
    bucket = pf.labelled("inquiries_6mo_count", [(0, "0"), (2, "1-2"), (5, "3-5"), (None, "6+")])
    return pf.bucket_means(t["credit_reports"], bucket, "fico_score_8", "inq_bucket")


@profile("STAT-008")
def score_by_utilization(t: Tables) -> DataFrame:
    return pf.bucket_means(t["credit_reports"], F.floor(F.col("revolving_utilization_ratio") * 10) * 10,
                           "fico_score_8", "util_bucket")


@profile("STAT-009")
def prepayment_curve(t: Tables) -> DataFrame:
    return pf.group_rates(t["loan_tape"], ["months_on_book"], {"prepay": "loan_status = 'PAID_OFF'"},
                          "loan_status IN ('CURRENT', 'PAID_OFF')")


@profile("STAT-010")
def grade_shares(t: Tables) -> DataFrame:
    return pf.shares(t["loan_tape"], "grade")


@profile("DQ-003")
def declared_columns(t: Tables) -> DataFrame:
    """Every declared column of every table: whether it is present and how many values it holds."""
    parts = [pf.declared_profile(t[n], t.declared[n]).withColumn("table_name", F.lit(n)) for n in t if n in t.declared]
    return reduce(DataFrame.unionByName, parts) if parts else t.spark.createDataFrame(
        [], "column_name string, present boolean, filled long, table_name string")


@profile("DQ-004")
def null_rates(t: Tables) -> DataFrame:
    return RELATIONS["null_rates"].build(t)


@profile("HYD-003")
def clean_tradelines(t: Tables) -> DataFrame:
    return pf.rate(t["credit_tradelines"], "times_30dpd = 0 AND times_60dpd = 0 AND times_90dpd = 0")


@profile("HYD-004")
def fraud_score_spread(t: Tables) -> DataFrame:
    return pf.dispersion(t["fraud_verification"], "overall_fraud_score")


@profile("HYD-005")
def bank_volume(t: Tables) -> DataFrame:
    return RELATIONS["bank_volume"].build(t)


@profile("HYD-007")
def clean_payments(t: Tables) -> DataFrame:
    return pf.rate(t["payments"], "suspense_amount = 0 AND unapplied_amount = 0")


@profile("HYD-008")
def autopay_shares(t: Tables) -> DataFrame:
    return pf.shares(t["payments"], "autopay_flag")


@profile("HYD-009")
def channel_mix(t: Tables) -> DataFrame:
    return pf.histogram(t["payments"], F.col("payment_channel"), "payment_channel")


@profile("HYD-010")
def returned_rate(t: Tables) -> DataFrame:
    return pf.rate(t["payments"], "nsf_flag = TRUE OR returned_flag = TRUE")


@profile("HYD-012")
def bureau_mix(t: Tables) -> DataFrame:
    return pf.histogram(t["credit_reports"], F.col("bureau_code"), "bureau_code")


@profile("CHK-001")
def delinquency_rate(t: Tables) -> DataFrame:
    return pf.rate(t["loan_tape"], "days_past_due >= 30")


@profile("CHK-002")
def income_medians(t: Tables) -> DataFrame:
    """Median income per state and, under a null state, overall."""
    apps = t["applications"]
    by_state = pf.exact_median(apps.filter("address_state IS NOT NULL"), ["address_state"],
                                  "annual_income", "median_income")
    overall = pf.exact_median(apps, [], "annual_income", "median_income")
    return by_state.unionByName(overall.select(
        F.lit(None).cast("string").alias("address_state"), "median_income"))


@profile("CHK-003")
def score_by_utilization_cut(t: Tables) -> DataFrame:
    cut = pf.labelled("revolving_utilization_ratio", [
        (0.0, "<=0"), (0.3, "0-0.3"), (0.5, "0.3-0.5"), (0.7, "0.5-0.7"), (1.0, "0.7-1.0"), (None, ">1.0")])
    return pf.bucket_means(t["credit_reports"], cut, "fico_score_8", "util_cut")


@profile("CHK-004")
def extremes(t: Tables) -> DataFrame:
    """Shares of extreme scores, ages and incomes."""
    age = age_years("application_date", "date_of_birth")
    return t["applications"].agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("fico_score_at_application") < 500).alias("score_below_500"),
        F.count_if(F.col("fico_score_at_application") > 800).alias("score_above_800"),
        F.count_if(age > 100).alias("age_above_100"),
        F.count_if(F.col("annual_income") > 500000).alias("income_above_500k"))


@profile("CHK-004-AMOUNTS")
def amount_range_by_product(t: Tables) -> DataFrame:
    """Smallest and largest loan amount per product."""
    rows = RELATIONS["loan_application"].build(t)
    return rows.groupBy(F.col("app_product_type").alias("product_type")).agg(
        F.min("original_loan_amount").alias("min_amount"), F.max("original_loan_amount").alias("max_amount"))


@profile("CHK-006")
def status_counts(t: Tables) -> DataFrame:
    parts = [pf.value_counts(t["applications"], ["decision_status"]),
             pf.value_counts(t["loan_tape"], ["loan_status"]),
             pf.value_counts(t["payments"], ["payment_channel"]),
             pf.value_counts(t["credit_reports"], ["bureau_code"])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@profile("CHK-011")
def unpaid_by_status(t: Tables) -> DataFrame:
    """Snapshot rows of loans without payments, per status.

    Snapshots are folded to (loan, status) counts before the existence test.
    """
    folded = ks.key_counts(t["loan_tape"], ["loan_id", "loan_status"], "rows_")
    return ks.orphans(folded, t["payments"], "loan_id").groupBy("loan_status").agg(
        F.sum("rows_").alias("row_count"))


@profile("CHK-012")
def identity_score_summary(t: Tables) -> DataFrame:
    """Score range and mean, overall (null decision) and per decision."""
    rows = t["fraud_verification"].select("application_id", "identity_verification_score")
    aggs = [F.count(F.lit(1)).alias("row_count"), F.min("identity_verification_score").alias("minimum"),
            F.max("identity_verification_score").alias("maximum"),
            F.avg("identity_verification_score").alias("mean")]
    overall = rows.agg(*aggs).select(F.lit(None).cast("string").alias("decision_status"), "*")
    decided = skew_join(rows, t["applications"].select("application_id", "decision_status"), "application_id",
                        "inner", t.hot("fraud_verification", "application_id"))
    return overall.unionByName(decided.groupBy("decision_status").agg(*aggs))
