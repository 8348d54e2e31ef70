"""Preparation of applications, credit reports, tradelines, fraud checks and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanward.functions import keyed
from loanward.functions.finance import installment, loan_amount, risk_rate

#: Columns an application file must have, and choices where one is absent.
REQUIRED = ("application_id", "fico_score_at_application", "decision_status")
CHOICES = {
    "product_type": ("PERSONAL", "AUTO"),
    "channel": ("ONLINE", "PARTNER", "DIRECT"),
    "state": ("CA", "NY", "TX", "FL", "IL"),
}
#: Weights in percent.
INCOME_VERIFICATION = (("VERIFIED", 70), ("UNVERIFIED", 20), ("PENDING", 10))
EMPLOYMENT_VERIFICATION = (("VERIFIED", 65), ("UNVERIFIED", 25), ("PENDING", 10))
LOAN_TERMS = ((24, 10), (36, 30), (48, 35), (60, 25))


def normalise_applications(df: DataFrame, position: Column | None = None) -> DataFrame:
    """Check required columns, upper-case the decision, fill absent attributes by key."""
    absent = [c for c in REQUIRED if c not in df.columns]
    if absent:
        raise ValueError(f"applications lack the column {absent[0]}")
    adds = {"decision_status": F.upper("decision_status")}
    for name, values in CHOICES.items():
        if name not in df.columns:
            at = keyed.bucket("application_id", 1 << 20, name) if position is None else position
            adds[name] = keyed.weighted_choice(at, [(v, 1) for v in values])
    return df.withColumns(adds)


def funded_applications(df: DataFrame, take_percent: int = 90, position: Column | None = None) -> DataFrame:
    """Approved applications that take the loan: a fixed share, chosen by key."""
    at = keyed.bucket("application_id", 100, "take") if position is None else F.pmod(position, F.lit(100))
    return df.filter((F.col("decision_status") == "APPROVED") & (at < take_percent))


def priced_loans(df: DataFrame, months: int | Column = 36, per_point: float = 0.0001) -> DataFrame:
    """Amount, rate, term and level installment of funded applications."""
    term = F.lit(months) if isinstance(months, int) else months
    return (df.withColumns({
        "original_loan_amount": loan_amount("annual_income"),
        "original_interest_rate": risk_rate("fico_score_at_application", "debt_to_income_ratio", per_point=per_point),
        "original_term_months": term})
        .withColumn("original_installment_amount", installment(
            "original_loan_amount", "original_interest_rate", "original_term_months")))


def loan_term(position: Column) -> Column:
    return keyed.weighted_choice(position, LOAN_TERMS)


def funding_date(decision_date: Column | str, position: Column, longest: int = 7) -> Column:
    """Decision date plus one to ``longest`` days."""
    d = F.col(decision_date) if isinstance(decision_date, str) else decision_date
    return F.date_add(d, keyed.in_band(position, 1, longest))


def credit_snapshot(df: DataFrame) -> DataFrame:
    """Derived columns of a credit report: key, second score, revolving trades."""
    return df.withColumns({
        "credit_report_id": F.concat(F.lit("CR-"), "application_id"),
        "vantage_score_3": (F.col("fico_score_8") * F.lit(0.9) + F.lit(50)).cast("int"),
        "revolving_trades_count": F.col("all_trades_count")})


def tradelines(reports: DataFrame) -> DataFrame:
    """Tradelines of a report: a mortgage for scores above 680, and a revolving line."""
    limit = F.lit(5000.0) + (F.col("fico_score_8") - 600) * F.lit(50.0)
    balance = limit * F.col("revolving_utilization_ratio")
    score = F.col("fico_score_8")

    def line(number: int, kind: str, bal: Column, lim: Column, pay: Column, years: int) -> Column:
        return F.struct(
            F.concat(F.col("credit_report_id"), F.lit(f"-TL{number}")).alias("tradeline_id"),
            F.lit(kind).alias("account_type"), F.lit("OPEN").alias("account_status"),
            bal.alias("current_balance"), lim.alias("credit_limit"), pay.alias("monthly_payment"),
            F.date_sub("report_date", 365 * years).alias("open_date"))

    mortgage = line(1, "MORTGAGE", F.lit(250000.0), F.lit(300000.0), F.lit(1500.0), 5)
    revolving = line(2, "REVOLVING", balance, limit, F.greatest(F.lit(25.0), balance * F.lit(0.02)), 2)
    lines = F.when(score > 680, F.array(mortgage, revolving)).otherwise(F.array(revolving))
    zero = F.lit(0)
    return reports.select("credit_report_id", F.inline(lines)).withColumns(
        {"times_30dpd": zero, "times_60dpd": zero, "times_90dpd": zero})


def _approved() -> Column:
    return F.coalesce(F.col("decision_status") == "APPROVED", F.lit(False))


def identity_score(position: Column) -> Column:
    """70 to 95 for approved applications, 10 to 60 for the others."""
    return F.when(_approved(), keyed.in_band(position, 70, 95)).otherwise(keyed.in_band(position, 10, 60))


def fraud_check_status(score: Column | str = "fraud_risk_score") -> Column:
    """PASSED below 400 when approved, FAILED above 600, FLAGGED otherwise."""
    s = F.col(score) if isinstance(score, str) else score
    return (F.when((s < 400) & _approved(), "PASSED").when(s > 600, "FAILED").otherwise("FLAGGED"))


def verification_columns(df: DataFrame, position: Column) -> DataFrame:
    return df.withColumns({
        "income_verification_status": keyed.weighted_choice(position, INCOME_VERIFICATION),
        "employment_verification_status": keyed.weighted_choice(position, EMPLOYMENT_VERIFICATION)})


def inquiry_count(position: Column) -> Column:
    """Few inquiries for approved high scores, many for rejected low ones."""
    score = F.col("fico_score_at_application")
    return (F.when(_approved() & (score > 700), keyed.in_band(position, 1, 3))
            .when(~_approved() & (score < 650), keyed.in_band(position, 5, 15))
            .otherwise(keyed.in_band(position, 2, 7)))


def reference_codes(applications: DataFrame) -> DataFrame:
    """Codes in use (product, channel, state) and the decisions.

    All three columns are stacked and made distinct in one aggregation; the decisions
    ride along as one array on the first code of each type-free row, added by union.
    """
    def code(kind: str, column: str, suffix: str, parent: str) -> Column:
        text = F.concat(F.col(column), F.lit(suffix)) if suffix else F.col(column)
        return F.struct(F.lit(kind).alias("code_type"), F.col(column).alias("code_value"),
                        text.alias("description"), F.lit(parent).alias("parent_code_value"))

    used = applications.select(F.inline(F.array(
        code("PRODUCT_TYPE", "product_type", " Loan", "Lending"),
        code("CHANNEL", "channel", " Channel", "Direct"),
        code("STATE", "state", "", "US")))).distinct()
    decisions = applications.sparkSession.createDataFrame(
        [("DECISION_STATUS", "APPROVED", "Application Approved", "Review Complete"),
         ("DECISION_STATUS", "DECLINED", "Application Declined", "Review Complete")],
        "code_type string, code_value string, description string, parent_code_value string")
    return used.unionByName(decisions)
