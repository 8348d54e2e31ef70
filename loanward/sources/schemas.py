"""Declared table schemas: CSV files with one row per column (column_name, data_type)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: SQL type names by prefix.  Money stays in doubles, as the tolerances are.
TYPE_NAMES = (
    ("VARCHAR", T.StringType()), ("CHAR", T.StringType()), ("TEXT", T.StringType()), ("STRING", T.StringType()),
    ("BIGINT", T.LongType()), ("INT", T.IntegerType()), ("SMALLINT", T.IntegerType()),
    ("DECIMAL", T.DoubleType()), ("NUMERIC", T.DoubleType()), ("FLOAT", T.DoubleType()), ("DOUBLE", T.DoubleType()),
    ("BOOL", T.BooleanType()), ("TIMESTAMP", T.TimestampType()), ("DATETIME", T.TimestampType()),
    ("DATE", T.DateType()),
)

#: The columns of the lending model that rules and profiles name.  A declared
#: schema, where one is loaded, takes the place of a table's entry.
MODEL: dict[str, tuple[str, ...]] = {
    "applications": (
        "application_id", "customer_id", "application_date", "decision_date", "application_timestamp",
        "date_of_birth", "decision_status", "fico_score_at_application", "debt_to_income_ratio", "annual_income",
        "product_type", "channel", "state", "address_state", "address_zip", "ssn_last4", "ssn_hash",
        "email_address", "phone_primary",
    ),
    "loan_tape": (
        "loan_id", "application_id", "customer_id", "snapshot_date", "origination_date", "first_payment_due_date",
        "note_signature_date", "maturity_date", "loan_status", "grade", "subgrade", "vintage_month",
        "vintage_year", "loan_payment_history", "months_on_book", "days_past_due", "worst_days_past_due",
        "original_term_months", "times_30_dpd", "times_60_dpd", "times_90_dpd", "times_120_dpd",
        "months_since_last_delinquency", "current_principal_balance", "current_interest_balance",
        "current_fees_balance", "payoff_amount", "disbursed_amount", "original_loan_amount",
        "original_interest_rate", "original_apr", "original_installment_amount", "origination_fee",
        "chargeoff_flag", "default_flag", "delinquent_flag", "interest_only_indicator", "never_paid_flag",
        "delinquent_0_30_flag", "delinquent_31_60_flag", "delinquent_61_90_flag", "delinquent_91_120_flag",
    ),
    "payments": (
        "payment_id", "loan_id", "customer_id", "payment_due_date", "payment_received_date", "snapshot_date",
        "return_date", "payment_status", "payment_type", "payment_method", "payment_channel", "return_reason_code",
        "scheduled_payment_amount", "scheduled_payment_amount_calc", "actual_payment_amount", "principal_paid",
        "interest_paid", "interest_accrued", "beginning_principal_balance", "ending_principal_balance",
        "fees_paid", "late_fee_paid", "late_fee_assessed", "suspense_amount", "unapplied_amount", "days_late",
        "grace_period_days", "nsf_flag", "returned_flag", "autopay_flag", "late_fee_waived", "is_extra_payment",
    ),
    "credit_reports": (
        "credit_report_id", "application_id", "report_date", "file_since_date", "fico_score_8", "vantage_score_3",
        "all_trades_count", "all_trades_open_count", "open_trades_count", "bankcard_trades_count",
        "bankcard_trades_open_count", "revolving_trades_count", "revolving_trades_open_count",
        "installment_trades_count", "installment_trades_open_count", "mortgage_trades_count",
        "trades_currently_past_due_count", "inquiries_6mo_count", "inquiries_last_6mo_count",
        "public_records_count", "bankruptcies_count", "delinquency_30_day_count", "months_since_oldest_trade",
        "revolving_utilization_ratio", "bureau_code",
    ),
    "credit_tradelines": (
        "tradeline_id", "credit_report_id", "account_type", "account_status", "current_balance", "credit_limit",
        "monthly_payment", "open_date", "times_30dpd", "times_60dpd", "times_90dpd",
    ),
    "fraud_verification": (
        "application_id", "fraud_check_timestamp", "fraud_check_status", "fraud_risk_score",
        "income_verification_status", "employment_verification_status", "identity_verification_score",
        "synthetic_identity_score", "overall_fraud_score", "identity_verification_result", "fraud_risk_tier",
        "ssn_deceased_flag", "address_verified", "ssn_issued_start_year",
    ),
    "bank_transactions": (
        "transaction_id", "application_id", "bank_acct_id", "transaction_date", "amount", "type", "category",
        "merchant", "description",
    ),
    "reference_codes": (
        "code_type", "code_value", "description",
    ),
}


def spark_type(name: str) -> T.DataType:
    """Spark type of a SQL type name such as ``VARCHAR(20)``."""
    upper = name.strip().upper()
    return next((t for prefix, t in TYPE_NAMES if re.match(prefix, upper)), T.StringType())


@dataclass(frozen=True)
class DeclaredColumn:
    name: str
    sql_type: str

    @property
    def type(self) -> T.DataType:
        return spark_type(self.sql_type)


def load_declared(spark: SparkSession, path: str) -> list[DeclaredColumn]:
    """The declared columns in file order.  A schema file has one short row per column."""
    rows = (spark.read.option("header", True).schema("column_name string, data_type string").csv(path)
            .coalesce(1).collect())
    return [DeclaredColumn(r.column_name.strip(), (r.data_type or "").strip()) for r in rows if r.column_name]


def load_schema(spark: SparkSession, path: str) -> T.StructType:
    """The declared columns as a Spark schema."""
    return T.StructType([T.StructField(c.name, c.type) for c in load_declared(spark, path)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str):
    """Read a CSV table with a declared schema (no inference pass over the data)."""
    return spark.read.option("header", True).schema(schema).csv(path)
