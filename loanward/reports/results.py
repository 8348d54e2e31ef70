"""Reports over result rows.  A result frame has one row per rule, so it is small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.plans.evaluate import violations
from loanward.plans.relations import RELATIONS
from loanward.plans.rule import FAIL, PASS, SKIP, Rule
from loanward.sources.tables import Tables

#: Share of rows that may violate, by severity.
SIGN_OFF_SHARES = {"CRITICAL": 0.0, "HIGH": 0.01, "MEDIUM": 0.05}


def settled(results: DataFrame) -> DataFrame:
    """The result rows, evaluated once and kept: one row per rule, so they fit the driver.

    Reports, gate and exit code on them scan no table again.
    """
    return results.sparkSession.createDataFrame(results.collect(), results.schema)


def foundation_report(results: DataFrame) -> DataFrame:
    """Seven columns with tolerance."""
    return results.select(
        F.col("rule_id").alias("Check ID"), F.col("title").alias("Check Name"), F.col("status").alias("Status"),
        F.col("violations").alias("Violations"), F.col("tolerance").alias("Tolerance"),
        F.col("details").alias("Details"), F.col("severity").alias("Severity"))


def extended_report(results: DataFrame) -> DataFrame:
    """Six columns without tolerance."""
    return foundation_report(results).drop("Tolerance").select(
        "Check ID", "Check Name", "Status", "Violations", "Severity", "Details")


def runner_report(results: DataFrame) -> DataFrame:
    """Four columns; a skipped rule carries -1 and the reason."""
    status = F.when(F.col("status") == SKIP, F.concat(F.lit("SKIP: "), "details")).otherwise(F.col("status"))
    return results.select(F.col("rule_id").alias("Check_ID"), F.col("title").alias("Check_Name"),
                          F.col("violations").alias("Violations"), status.alias("Status"))


def totals(results: DataFrame) -> DataFrame:
    """Counts by outcome and the pass rate.  Skipped rules are outside the rate, and shown."""
    def count(*states: str):
        return F.count_if(F.col("status").isin(*states))
    out = results.agg(
        F.count(F.lit(1)).alias("total"), count(PASS, FAIL).alias("evaluated"), count(PASS).alias("passed"),
        count(FAIL).alias("failed"), count(SKIP).alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("status") == FAIL, F.col("violations"))), F.lit(0)).alias("violations"))
    return out.withColumn("pass_rate", F.try_divide(F.col("passed") * 100.0, F.col("evaluated")))


def failed(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == FAIL).select("rule_id", "title", "violations", "severity")


def skipped(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == SKIP).select("rule_id", "title", "details")


def by_severity(results: DataFrame) -> DataFrame:
    return results.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("rules")).orderBy("severity", "status")


def by_category(results: DataFrame) -> DataFrame:
    """Pass rate per category; every rule is in exactly one."""
    out = results.groupBy("category").agg(
        F.count_if(F.col("status").isin(PASS, FAIL)).alias("evaluated"),
        F.count_if(F.col("status") == PASS).alias("passed"))
    return out.withColumn("pass_rate", F.try_divide(F.col("passed") * 100.0, F.col("evaluated")))


def by_number_range(results: DataFrame, ranges: Sequence[tuple[int, int, str]]) -> DataFrame:
    """Pass rate per range of rule numbers, the number being the digits that end the id."""
    number = F.regexp_extract("rule_id", "([0-9]+)$", 1).cast("int")
    name = None
    for low, high, label in ranges:
        test = number.between(low, high)
        name = F.when(test, label) if name is None else name.when(test, label)
    return by_category(results.withColumn("category", name).filter("category IS NOT NULL"))


def save_csv(report: DataFrame, path: str) -> None:
    """One CSV file with header; a report has a row per rule."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def gate(results: DataFrame) -> bool:
    """True when no rule fails."""
    return results.filter(F.col("status") == FAIL).isEmpty()


def exit_code(results: DataFrame) -> int:
    return 0 if gate(results) else 1


def examples(rule: Rule, tables: Tables, excess: str, limit: int = 10, tie_break: Sequence[str] | None = None,
             relations=RELATIONS) -> DataFrame:
    """The worst violating rows of a rule, by an excess expression: a top-k report."""
    rows = violations(rule, tables, relations).withColumn("excess", F.expr(excess))
    keys = list(tie_break or relations[rule.relation].identity)
    return rows.orderBy(F.col("excess").desc(), *keys).limit(limit)


def compare(versions: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of several result sets side by side, with the reduction to the last."""
    names = list(versions)
    out = None
    for name, results in versions.items():
        part = results.select("rule_id", F.col("status").alias(f"{name}_status"),
                              F.when(F.col("status") != SKIP, F.col("violations")).alias(f"{name}_violations"))
        out = part if out is None else out.join(part, "rule_id", "full_outer")
    first, last = F.col(f"{names[0]}_violations"), F.col(f"{names[-1]}_violations")
    return out.withColumns({"delta": last - first,
                            "reduction_pct": F.try_divide((first - last) * 100.0, first)})


def sign_off(results: DataFrame, rows: Mapping[str, str] | None = None) -> DataFrame:
    """Per severity: rules over the allowed share of rows, and whether the group signs off.

    Critical rules allow no violation; the others compare with the rows they looked at
    (``base``), a rule without a base counting as over when it fails.
    """
    allowed = None
    for severity, share in SIGN_OFF_SHARES.items():
        test = F.col("severity") == severity
        allowed = F.when(test, F.lit(share)) if allowed is None else allowed.when(test, F.lit(share))
    judged = results.filter(F.col("status").isin(PASS, FAIL) & allowed.isNotNull())
    share = F.try_divide(F.col("violations").cast("double"), F.col("base"))
    over = F.when(F.col("violations") == 0, F.lit(False)).when(
        (allowed > 0) & share.isNotNull(), share >= allowed).otherwise(
        F.when(allowed > 0, F.col("status") == FAIL).otherwise(F.lit(True)))
    return judged.groupBy("severity").agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(over).alias("rules_over"),
        F.when(F.count_if(over) == 0, "PASS").otherwise("FAIL").alias("status"))
