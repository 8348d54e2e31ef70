"""Named queries over the star-schema tables and the lending views made from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanward.operators.quantiles import exact_quantiles
from loanward.operators.sieve import sieved_holders, sieved_orphans
from loanward.plans.bindings import KINDS, STAR_TABLES, star_tables
from loanward.plans.drilldown import worst_offenders
from loanward.plans.estimates import estimates
from loanward.plans.evaluate import evaluate, offenders
from loanward.plans.measures import judge_parts, measure_parts, row_rules, save_parts, write_judged
from loanward.plans.packs import (
    CATALOGUE, CATALOGUE_SPEC, CHECKS, FOUNDATION, FOUNDATION_SPEC, REDUCED, RUNNER, RUNNER_SPEC)
from loanward.plans.packs.runner import RUNNER_EXCESS
from loanward.plans.preparations import PREPARATIONS
from loanward.plans.profiles import PROFILES
from loanward.plans.relations import RELATIONS
from loanward.plans.rule import Pack, Rule
from loanward.reports import results as rp
from loanward.sources.delimited import read_declared_csv
from loanward.sources.footers import Bound, facts_table, judge_bounds
from loanward.sources.layout import Layout, bucket_count, open_bucketed, shared_folder, write_bucketed
from loanward.sources.lending_views import lending_frames
from loanward.sources.schemas import DeclaredColumn
from loanward.sources.tables import Tables, sample_tables, size_shuffles, table_stats

Query = Callable[[SparkSession, str], DataFrame]

#: Rules whose result is a profile or a rate rather than a list of offenders.
PROFILED = {"STAT-001", "STAT-002", "STAT-003", "STAT-004", "STAT-005", "STAT-006", "STAT-007", "STAT-008",
            "STAT-009", "STAT-010", "DQ-003", "DQ-004", "HYD-003", "HYD-004", "HYD-005", "HYD-007", "HYD-008",
            "HYD-009", "HYD-010", "HYD-012", "CHK-001"}
#: Decimals of averages and medians; the sums behind them depend on the order of rows.
DIGITS = {"STAT-006": 4, "CHK-002": 4}


def lending(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(lending_frames(spark, sf_dir))


def _plain(df: DataFrame) -> DataFrame:
    """Dates as text, for comparison between engines."""
    return df.select([F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, (T.DateType, T.TimestampType))
                      else F.col(f.name) for f in df.schema.fields])


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                      else F.col(f.name) for f in df.schema.fields])


def _rule(rule: Rule, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(offenders(rule, lending(spark, sf_dir)))


def _pack(pack: Pack, spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(pack, lending(spark, sf_dir)).select("rule_id", "violations", "status")


def _profile(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(PROFILES[name](lending(spark, sf_dir)), DIGITS.get(name, 6))


def _kind(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return KINDS[name](star_tables(spark, sf_dir))


def _prepared(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PREPARATIONS[name](lending(spark, sf_dir))


def _foundation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(FOUNDATION, lending(spark, sf_dir))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rp.totals(_foundation(spark, sf_dir)))


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.failed(_foundation(spark, sf_dir)).select("rule_id", "violations")


def _by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.by_severity(evaluate(CATALOGUE, lending(spark, sf_dir)))


def _by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rp.by_category(_foundation(spark, sf_dir)))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = rp.examples(RUNNER.rule("RUN-043"), lending(spark, sf_dir), "open_trades_count - all_trades_count")
    return worst.select("credit_report_id", "application_id", "open_trades_count", "all_trades_count", "excess")


def _worst_of_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten worst offenders of every failing runner rule; these rules allow nothing, so any offender makes one fail."""
    return worst_offenders(RUNNER, lending(spark, sf_dir), RUNNER_EXCESS, apart=True).drop("variant")


def _skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runner pack where a table and a column are absent: the rules that read them are skipped, and never pass."""
    tables = lending(spark, sf_dir)
    less = {n: f.drop("interest_accrued") if n == "payments" else f for n, f in tables.items() if n != "bank_transactions"}
    return rp.runner_report(evaluate(RUNNER, Tables(less, tables.as_of))).select(
        F.col("Check_ID").alias("check_id"), F.col("Violations").alias("violations"), F.col("Status").alias("status"))


def _saved_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foundation report as it stands in its CSV file, with the exit code of the gate beside it."""
    results, path = rp.settled(_foundation(spark, sf_dir)), f"{shared_folder(spark)}/report"
    rp.save_csv(rp.foundation_report(results), path)
    saved = spark.read.option("header", True).schema(
        "check_id string, check_name string, status string, violations long, tolerance double, details string, severity string").csv(path)
    return saved.drop("check_name").withColumn("exit_code", F.lit(rp.exit_code(results)).cast("long"))


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written variants, judged like the packs."""
    rules = [*FOUNDATION_SPEC, *RUNNER_SPEC, *CATALOGUE_SPEC]
    return evaluate(rules, lending(spark, sf_dir)).select("rule_id", "variant", "violations", "status")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after two repairs: unknown statuses and paid missed payments taken out."""
    before = lending(spark, sf_dir)
    after = before.replace(
        loan_tape=before["loan_tape"].filter("loan_status <> 'FROZEN'"),
        payments=before["payments"].filter("NOT (payment_status = 'MISSED' AND actual_payment_amount > 0)"))
    return _rounded(rp.compare({"v1": evaluate(FOUNDATION, before, apart=True), "v2": evaluate(FOUNDATION, after, apart=True)}))


def _sign_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.sign_off(evaluate(CATALOGUE, lending(spark, sf_dir)))


def _payment_rules() -> list[Rule]:
    return row_rules([*FOUNDATION, *RUNNER, *CATALOGUE], "payments")


def _judged_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments written by month of their due date and judged by their row rules on the way."""
    tables = lending(spark, sf_dir)
    dated = tables["payments"].withColumn("month", F.date_format("payment_due_date", "yyyy-MM"))
    return write_judged(dated, shared_folder(spark), "payments", _payment_rules(), tables, ["month"]).select(
        "rule_id", "violations", "status")


#: Months whose payments come again, repaired.
LATE_MONTHS = tuple(f"2023-{m:02d}" for m in range(7, 13))


def _late_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments judged from saved months, after those of half a year came again without returned ones."""
    before, rules, path = lending(spark, sf_dir), _payment_rules(), f"{shared_folder(spark)}/state"
    after = before.replace(payments=before["payments"].filter("NOT returned_flag"))
    save_parts(measure_parts(rules, before, "payments", "payment_due_date"), path)
    save_parts(measure_parts(rules, after, "payments", "payment_due_date", LATE_MONTHS), path)
    return judge_parts(rules, after, "payments", path).select("rule_id", "violations", "status")


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(FOUNDATION, sample_tables(lending(spark, sf_dir), 0.10)).select("rule_id", "violations", "status")


#: Tables whose row rules are estimated from a sample of families.
FAMILY_TABLES = ("applications", "loan_tape", "payments", "credit_reports", "credit_tradelines", "fraud_verification")


def _estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foundation rules on single rows, from a tenth of the families, scaled up with intervals."""
    rules = [r for t in FAMILY_TABLES for r in row_rules(FOUNDATION, t)]
    return _rounded(estimates(rules, lending(spark, sf_dir), 0.10).drop("variant"), 4)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stats(star_tables(spark, sf_dir))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls and bounds of all columns of the star tables, from footers where these hold them."""
    return facts_table(spark, {n: f"{sf_dir}/{n}.parquet" for n in STAR_TABLES})


#: Ranges of the star tables: those of whole numbers and without an upper end can be proved by footers.
STAR_BOUNDS = {
    "lineitem": (Bound("l_linenumber", 1, 7, nulls=False), Bound("l_quantity", 1), Bound("l_quantity", 1, 50),
                 Bound("l_discount", 0.01, 0.09), Bound("l_orderkey", 10, nulls=False), Bound("l_extendedprice", nulls=False)),
    "orders": (Bound("o_totalprice", 0, nulls=False), Bound("o_orderkey", 0), Bound("o_totalprice", 2000, 400000)),
    "customer": (Bound("c_nationkey", 0, 24, nulls=False), Bound("c_acctbal", 0)),
    "events": (Bound("user_id", 0, nulls=False), Bound("value", 0, 300), Bound("event_id", nulls=False)),
    "documents": (Bound("n_chars", 1, 10000), Bound("lang", nulls=False)),
}


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star tables' ranges: proved by footers, or counted in row groups that may break them."""
    return reduce(DataFrame.unionByName, [
        judge_bounds(spark, f"{sf_dir}/{t}.parquet", own).withColumn("table_name", F.lit(t)) for t, own in STAR_BOUNDS.items()])


def _by_loan(spark: SparkSession, sf_dir: str) -> Layout:
    """Loan tape and payments written in buckets of their loan, and opened again."""
    keys, folder = {"loan_tape": "loan_id", "payments": "loan_id"}, shared_folder(spark)
    tables = lending(spark, sf_dir)
    buckets = bucket_count(tables, keys)
    write_bucketed(tables, folder, keys, buckets, {"loan_tape": ["snapshot_date"]})
    return open_bucketed(spark, folder, keys, buckets)


def _bucketed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_loan(spark, sf_dir).relation(RELATIONS["loan_ledger"])


def _bucketed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with the status and balance before them, from a window that moves no rows."""
    steps = _by_loan(spark, sf_dir).relation(RELATIONS["loan_steps"])
    return _plain(steps.select("loan_id", "snapshot_date", "loan_status", "prev_loan_status", "prev_current_principal_balance", "_n").groupBy(
        "loan_id", "snapshot_date", "loan_status", "prev_loan_status", "prev_current_principal_balance").agg(F.sum("_n").alias("copies")))


#: Ranks that a distribution is described by.
PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _line_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the lines' measures by flag and status, as values that occur."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size_shuffles([lines])
    return _rounded(exact_quantiles(lines, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"],
                                    PROBABILITIES, interpolate=False))


def _state_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of income, score and debt ratio by state."""
    return _rounded(exact_quantiles(lending(spark, sf_dir)["applications"], ["address_state"], [
        "annual_income", "fico_score_at_application", "debt_to_income_ratio"], PROBABILITIES))


def _urgent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of large urgent orders, by a filter of these orders' keys in the lines' scan."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    return sieved_holders(lines, orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")


def _orders_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers that are not among those in debt."""
    debtors = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_acctbal < -500").withColumnRenamed("c_custkey", "o_custkey")
    return sieved_orphans(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), debtors, "o_custkey")


#: The orders' declaration; one column is too short for some values, one is not in the file.
ORDER_COLUMNS = tuple(DeclaredColumn(*c) for c in (
    ("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_totalprice", "DECIMAL(12,2)"), ("o_orderdate", "DATE"),
    ("o_orderpriority", "VARCHAR(8)"), ("o_clerk", "VARCHAR(15)")))


def _orders_as_csv(spark: SparkSession, sf_dir: str) -> str:
    """All orders as CSV lines, of which some have words for prices and dates, or fields too many."""
    path = f"{shared_folder(spark)}/orders"
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("""concat_ws(',', o_orderkey, o_custkey, o_orderstatus,
        if(o_orderkey % 97 = 3, 'n/a', CAST(o_totalprice AS STRING)), if(o_orderkey % 89 = 5, 'unknown', CAST(CAST(o_orderdate AS DATE) AS STRING)),
        concat('"', o_orderpriority, '"'), if(o_orderkey % 101 = 7, 'left,over', NULL)) AS value""").write.text(path)
    return path


def _declared_csv(spark: SparkSession, sf_dir: str):
    return read_declared_csv(spark, _orders_as_csv(spark, sf_dir), ORDER_COLUMNS, [
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])


def _csv_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the orders' CSV lines lose by their declaration."""
    return _declared_csv(spark, sf_dir).faults()


def _csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as the declared load gives them, without malformed lines."""
    return _plain(_declared_csv(spark, sf_dir).rows.filter("_malformed IS NULL").drop("_malformed"))


def query_name(rule: Rule) -> str:
    name = rule.id.lower().replace("-", "_")
    return name if rule.variant == "code" or rule.id == "FND-053" else f"{name}_{rule.variant}"


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {"io_02_table_stats": _stats, "io_02_column_facts": _facts, "k05_proved_bounds": _bounds,
                             "io_04_bucketed_ledger": _bucketed_ledger, "io_04_bucketed_steps": _bucketed_steps,
                             "io_03_declared_faults": _csv_faults, "io_03_declared_rows": _csv_rows,
                             "k32_sieved_holders": _urgent_lines, "k01_sieved_orphans": _orders_outside,
                             "k24_quantiles": _line_quantiles, "stat_006_quantiles": _state_quantiles}
    out.update({name: partial(_kind, name) for name in KINDS})
    for pack in (FOUNDATION, RUNNER, CATALOGUE, CHECKS, FOUNDATION_SPEC, RUNNER_SPEC, CATALOGUE_SPEC):
        for rule in pack:
            if rule.id not in PROFILED or rule.variant != "code":
                out[query_name(rule)] = partial(_rule, rule)
    out.update({name.lower().replace("-", "_") + ("_profile" if name.startswith("CHK") else ""): partial(_profile, name)
                for name in PROFILES})
    out.update({
        "pack_foundation": partial(_pack, FOUNDATION), "pack_reduced": partial(_pack, REDUCED),
        "pack_runner": partial(_pack, RUNNER),
        "pack_specs": _specs, "pack_catalogue": partial(_pack, CATALOGUE), "pack_checks": partial(_pack, CHECKS),
        "rp_05_totals": _totals, "rp_06_failed": _failed, "rp_07_by_severity": _by_severity,
        "rp_08_by_category": _by_category, "rp_11_examples": _examples, "rp_11_worst_of_pack": _worst_of_pack, "rp_12_versions": _versions,
        "rp_02_skipped": _skipped, "rp_09_saved_report": _saved_report, "rp_02_judged_write": _judged_write, "rp_12_late_months": _late_months,
        "rp_13_sign_off": _sign_off, "rp_14_sampled_run": _sampled, "rp_14_estimates": _estimated,
    })
    out.update({name: partial(_prepared, name) for name in PREPARATIONS})
    return out
