"""The relations that the lending rules test.

Joins name their columns, fold repeated loan attributes before shuffling, and take the
hot keys of the larger side into account.  Columns a table lacks are left out; the rule
that reads them is then skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanward.functions.sqltext import over
from loanward.operators import anchors as an
from loanward.operators import keys as ks
from loanward.operators import profile as pf
from loanward.operators.joins import fold, weighted_join
from loanward.operators.skew import skew_join, with_previous
from loanward.plans.rule import Relation
from loanward.sources.tables import Tables

RELATIONS: dict[str, Relation] = {}

A, L, P = "applications", "loan_tape", "payments"
CR, CT, FV = "credit_reports", "credit_tradelines", "fraud_verification"
BT, RC = "bank_transactions", "reference_codes"


def relation(name: str, needs: dict[str, tuple[str, ...]], *identity: str):
    def register(build):
        RELATIONS[name] = Relation(name, needs, build, identity)
        return build
    return register


def _table(name: str, *identity: str) -> None:
    relation(name, {name: ()}, *identity)(lambda t: t[name])


_table(A, "application_id")
_table(L, "loan_id", "snapshot_date")
_table(P, "payment_id")
_table(CR, "credit_report_id")
_table(CT, "tradeline_id")
_table(FV, "application_id")
_table(BT, "transaction_id")
_table(RC, "code_type", "code_value")


# --- a fact with its application -------------------------------------------------

@relation("loan_application", {L: ("application_id",), A: ("application_id",)}, "loan_id")
def loan_application(t: Tables) -> DataFrame:
    """Loans with their application; snapshots of a loan are folded first."""
    hot_left, hot_right = t.hot(L, "application_id"), t.hot(A, "application_id")
    loans = t.project(L, ["loan_id", "application_id", "customer_id", "origination_date",
                          "original_loan_amount", "original_term_months"])
    apps = t.project(A, ["application_id", "customer_id", "decision_status", "application_date",
                         "product_type", "annual_income"])
    return weighted_join(loans, apps, "application_id", "app_", fold_left=True,
                         fold_right=bool(hot_right), hot=hot_left)


@relation("report_application", {CR: ("application_id",), A: ("application_id",)}, "credit_report_id")
def report_application(t: Tables) -> DataFrame:
    hot_left, hot_right = t.hot(CR, "application_id"), t.hot(A, "application_id")
    reports = t.project(CR, ["credit_report_id", "application_id", "report_date", "file_since_date", "fico_score_8"])
    apps = t.project(A, ["application_id", "application_date", "date_of_birth", "fico_score_at_application"])
    return weighted_join(reports, apps, "application_id", "app_", fold_left=bool(hot_left),
                         fold_right=bool(hot_right), hot=hot_left)


@relation("fraud_application", {FV: ("application_id",), A: ("application_id",)}, "application_id")
def fraud_application(t: Tables) -> DataFrame:
    hot_left, hot_right = t.hot(FV, "application_id"), t.hot(A, "application_id")
    checks = t.project(FV, ["application_id", "fraud_check_timestamp", "ssn_deceased_flag", "ssn_issued_start_year",
                            "identity_verification_result", "fraud_risk_tier", "fraud_check_status",
                            "income_verification_status", "employment_verification_status", "address_verified"])
    apps = t.project(A, ["application_id", "decision_status", "application_date", "application_timestamp",
                         "date_of_birth", "address_zip"])
    return weighted_join(checks, apps, "application_id", "app_", fold_left=bool(hot_left),
                         fold_right=bool(hot_right), hot=hot_left)


@relation("origination_decision", {L: ("application_id", "loan_id", "origination_date"),
                                   A: ("application_id", "decision_date")}, "loan_id")
def origination_decision(t: Tables) -> DataFrame:
    """Distinct loan originations with the decision date of their application."""
    loans = t[L].select("application_id", "loan_id", "origination_date").distinct()
    apps = t[A].select("application_id", "decision_date")
    return weighted_join(loans, apps, "application_id", "app_", fold_left=False,
                         fold_right=bool(t.hot(A, "application_id")), hot=t.hot(L, "application_id"))


@relation("tradeline_report", {CT: ("credit_report_id",), CR: ("credit_report_id",)}, "tradeline_id")
def tradeline_report(t: Tables) -> DataFrame:
    hot_left, hot_right = t.hot(CT, "credit_report_id"), t.hot(CR, "credit_report_id")
    lines = t.project(CT, ["tradeline_id", "credit_report_id", "open_date"])
    reports = t.project(CR, ["credit_report_id", "report_date"])
    return weighted_join(lines, reports, "credit_report_id", "rep_", fold_left=bool(hot_left),
                         fold_right=bool(hot_right), hot=hot_left)


@relation("tradeline_report_application",
          {CT: ("credit_report_id",), CR: ("credit_report_id", "application_id"), A: ("application_id",)},
          "tradeline_id")
def tradeline_report_application(t: Tables) -> DataFrame:
    """Tradelines of reports whose application exists, once per such application."""
    reports = t.project(CR, ["credit_report_id", "application_id", "report_date"])
    apps = ks.key_counts(t[A].select("application_id"), "application_id", "_na")
    known = skew_join(reports, apps, "application_id", "inner", t.hot(CR, "application_id"))
    known = known.groupBy(*[c for c in known.columns if c not in ("application_id", "_na")]).agg(
        F.sum("_na").alias("_na"))
    lines = t.project(CT, ["tradeline_id", "credit_report_id", "open_date"])
    known = known.select("credit_report_id", "_na", *[
        F.col(c).alias("rep_" + c) for c in known.columns if c == "report_date"])
    out = skew_join(fold(lines, "_nl") if t.hot(CT, "credit_report_id") else
                    lines.withColumn("_nl", F.lit(1).cast("long")),
                    known, "credit_report_id", "inner", t.hot(CT, "credit_report_id"))
    return out.withColumn("_n", F.col("_nl") * F.col("_na")).drop("_nl", "_na")


@relation("report_loan", {CR: ("application_id",), L: ("application_id",)}, "credit_report_id")
def report_loan(t: Tables) -> DataFrame:
    """Reports with the loan snapshots of their application, snapshots folded by status."""
    loans = t.project(L, ["application_id", "loan_status"])
    reports = t.project(CR, ["credit_report_id", "application_id", "delinquency_30_day_count"])
    return weighted_join(loans, reports, "application_id", "", fold_left=True,
                         fold_right=bool(t.hot(CR, "application_id")), hot=t.hot(L, "application_id"))


@relation("customer_triple", {A: ("application_id", "customer_id"),
                              L: ("application_id", "loan_id", "customer_id"),
                              P: ("loan_id", "customer_id")}, "loan_id")
def customer_triple(t: Tables) -> DataFrame:
    """Application, loan and payment customers side by side.

    Loans and payments are folded to distinct customers first, so that the pairs of one
    loan are counted by multiplication and never produced.
    """
    loans = t[L].select("application_id", "loan_id", "customer_id")
    apps = t[A].select("application_id", "customer_id")
    both = weighted_join(loans, apps, "application_id", "app_", fold_left=True,
                         fold_right=bool(t.hot(A, "application_id")), hot=t.hot(L, "application_id"))
    paid = fold(t[P].select("loan_id", F.col("customer_id").alias("pay_customer_id")), "_np")
    return both.join(paid, "loan_id").withColumn("_n", F.col("_n") * F.col("_np")).drop("_np")


# --- key ledgers: which tables hold a key, and how often -----------------------------

def ledger(t: Tables, key: str, sources: dict[str, dict[str, str]]) -> DataFrame:
    """One row per key value with sums over several tables.

    ``sources`` maps a table to its measures (name, SQL amount per row).  All tables are
    stacked as narrow rows and summed in one aggregation, combined on the map side, so
    existence, orphan and cardinality rules on a key share one shuffle and no key can be
    too frequent for it.  Null is a key of its own.
    """
    if len(sources) == 2 and all(t.bucketed.get(table) == key for table in sources):
        return _bucketed_ledger(t, key, sources)
    names = [m for measures in sources.values() for m in measures]
    frames, selects = {}, []
    for table, measures in sources.items():
        present = t.columns(table)
        if key not in present:
            continue
        frames[table] = t[table]
        cells = ", ".join(f"CAST({measures.get(n, '0')} AS BIGINT) AS {n}" for n in names)
        selects.append(f"SELECT {key}, {cells} FROM {{{table}}}")
    sums = ", ".join(f"sum({n}) AS {n}" for n in names)
    return over(frames, f"SELECT {key}, {sums} FROM ({' UNION ALL '.join(selects)}) GROUP BY {key}")


def _bucketed_ledger(t: Tables, key: str, sources: dict[str, dict[str, str]]) -> DataFrame:
    """The ledger of two tables in buckets of the key: each is summed where it lies, and the sums meet there."""
    def sums(table: str) -> str:
        cells = ", ".join(f"sum(CAST({e} AS BIGINT)) AS {n}" for n, e in sources[table].items())
        return f"SELECT {key}, {cells} FROM {{{table}}} WHERE {key} IS NOT NULL GROUP BY {key}"

    one, two = sources
    names = [(side, n) for side, table in (("a", one), ("b", two)) for n in sources[table]]
    cells = ", ".join(f"coalesce({side}.{n}, 0L) AS {n}" for side, n in names)
    kind = dict(t[one].dtypes)[key]
    frames = {table: t[table] for table in sources}
    known = over(frames, f"""
        SELECT /*+ MERGE(b) */ coalesce(a.{key}, b.{key}) AS {key}, {cells}
        FROM ({sums(one)}) a FULL JOIN ({sums(two)}) b ON a.{key} = b.{key}""")
    # Null is a key of its own: one row of sums, if it occurs at all.
    own = {table: ", ".join(f"CAST({sources[table].get(n, '0')} AS BIGINT) AS {n}" for _, n in names) for table in sources}
    null = over(frames, f"""
        SELECT CAST(NULL AS {kind}) AS {key}, {', '.join(f'sum({n}) AS {n}' for _, n in names)}
        FROM (SELECT {own[one]} FROM {{{one}}} WHERE {key} IS NULL UNION ALL SELECT {own[two]} FROM {{{two}}} WHERE {key} IS NULL)
        HAVING count(1) > 0""")
    return known.unionByName(null)


def _flag(t: Tables, table: str, columns: tuple[str, ...], condition: str) -> str:
    """1 where the condition holds; 0 where a column it reads is absent."""
    known = all(c in t.columns(table) for c in columns)
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END" if known else "0"


@relation("application_ledger", {}, "application_id")
def application_ledger(t: Tables) -> DataFrame:
    return ledger(t, "application_id", {
        A: {"apps": "1", "approved": _flag(t, A, ("decision_status",), "decision_status = 'APPROVED'")},
        L: {"snapshots": "1"}, CR: {"reports": "1"}, FV: {"checks": "1"}, BT: {"transactions": "1"}})


@relation("loan_ledger", {}, "loan_id")
def loan_ledger(t: Tables) -> DataFrame:
    return ledger(t, "loan_id", {
        L: {"snapshots": "1",
            "delinquent": _flag(t, L, ("loan_status",), "loan_status LIKE '%DELINQUENT%'"),
            "never_paid": _flag(t, L, ("never_paid_flag",), "never_paid_flag = TRUE")},
        P: {"payments": "1",
            "missed": _flag(t, P, ("payment_status",), "payment_status = 'MISSED'"),
            "posted": _flag(t, P, ("payment_status", "actual_payment_amount"),
                            "payment_status = 'POSTED' AND actual_payment_amount > 0")}})


@relation("report_ledger", {}, "credit_report_id")
def report_ledger(t: Tables) -> DataFrame:
    return ledger(t, "credit_report_id", {CR: {"reports": "1"}, CT: {"lines": "1"}})


# --- existence ---------------------------------------------------------------------

def _anti(name: str, child: str, parent: str, key: str, *identity: str) -> None:
    relation(name, {child: (key,), parent: (key,)}, *identity)(
        lambda t: ks.orphans(t[child], t[parent], key, hot=t.hot(child, key)))


_anti("application_without_report", A, CR, "application_id", "application_id")
_anti("application_without_fraud", A, FV, "application_id", "application_id")
_anti("payment_orphan", P, L, "loan_id", "payment_id")
_anti("loan_orphan", L, A, "application_id", "loan_id", "snapshot_date")
_anti("report_orphan", CR, A, "application_id", "credit_report_id")
_anti("tradeline_orphan", CT, CR, "credit_report_id", "tradeline_id")
_anti("fraud_orphan", FV, A, "application_id", "application_id")
_anti("bank_orphan", BT, A, "application_id", "transaction_id")
_anti("loan_without_payment", L, P, "loan_id", "loan_id")


@relation("snapshot_without_missed", {L: ("loan_id",), P: ("loan_id", "payment_status")}, "loan_id", "snapshot_date")
def snapshot_without_missed(t: Tables) -> DataFrame:
    missed = t[P].filter("payment_status = 'MISSED'")
    return ks.orphans(t[L], missed, "loan_id", hot=t.hot(L, "loan_id"))


@relation("snapshot_with_posted", {L: ("loan_id",), P: ("loan_id", "payment_status", "actual_payment_amount")},
          "loan_id", "snapshot_date")
def snapshot_with_posted(t: Tables) -> DataFrame:
    posted = t[P].filter("payment_status = 'POSTED' AND actual_payment_amount > 0")
    return ks.holders(t[L], posted, "loan_id", hot=t.hot(L, "loan_id"))


# --- payments against the loan ----------------------------------------------------

def loan_marks(t: Tables, sides: tuple[str, ...] = ("payment", "total")) -> DataFrame:
    """What payments are held against: per loan its distinct originations, first due dates,
    amounts and statuses, a status with the dates at which it was first and last seen.

    ``side`` tells whether single payments or a loan's totals are compared with the mark.
    Rows of the tape move once, narrow, to where their loan is: there they are folded, become one
    row for each mark and are made distinct. With hot loans they are folded before each move instead.
    """
    present = set(t.columns(L))
    seen = "snapshot_date" if "snapshot_date" in present else "CAST(NULL AS DATE)"
    never = "CAST(NULL AS DATE)"
    opened = "loan_status <> 'CHARGED_OFF'" if "loan_status" in present else "FALSE"
    marks = (
        ("payment", "'status'", "loan_status", "mark_status"),
        ("payment", "'origination'", "origination_date", "mark_date"),
        ("payment", "'first_due'", "first_payment_due_date", "mark_date"),
        ("total", "'origination'", "origination_date", "mark_date"),
        ("total", f"CASE WHEN {opened} THEN 'open_origination' END", "origination_date", "mark_date"),
        ("total", "'amount'", "original_loan_amount", "mark_amount"),
    )
    rows, used = [], {"loan_status": "loan_status"} if "loan_status" in present else {}
    for side, mark, column, target in marks:
        if side in sides and column in present:
            used[column] = column
            cells = {"mark_date": "CAST(NULL AS DATE)", "mark_amount": "CAST(NULL AS DOUBLE)",
                     "mark_status": "CAST(NULL AS STRING)", "first_seen": never, "last_seen": never, target: column}
            if target == "mark_status":
                cells |= {"first_seen": "first_seen", "last_seen": "last_seen"}
            rows.append(f"struct('{side}' AS side, {mark} AS mark, "
                        + ", ".join(f"{e} AS {n}" for n, e in cells.items()) + ")")
    picked = ", ".join(used)
    placed = "" if t.hot(L, "loan_id") or t.hot(P, "loan_id") else "/*+ REPARTITION(loan_id) */"
    return over({"loans": t[L]}, f"""
        SELECT loan_id, side, mark, mark_date, mark_amount, mark_status, min(first_seen) AS first_seen, max(last_seen) AS last_seen
        FROM (SELECT loan_id, inline(array({', '.join(rows)}))
              FROM (SELECT loan_id, {picked}, min(seen) AS first_seen, max(seen) AS last_seen
                    FROM (SELECT {placed} loan_id, {picked}, {seen} AS seen FROM {{loans}}) GROUP BY loan_id, {picked}))
        WHERE mark IS NOT NULL
        GROUP BY loan_id, side, mark, mark_date, mark_amount, mark_status""")


_PAYMENT_MARK = ["payment_id", "loan_id", "payment_received_date", "actual_payment_amount",
                 "payment_type", "scheduled_payment_amount"]


def _payment_totals(t: Tables) -> DataFrame:
    measures = {name: c for name, column, c in (
        ("first_received", "payment_received_date", F.min("payment_received_date")),
        ("first_due_date", "payment_due_date", F.min("payment_due_date")),
        ("total_paid", "actual_payment_amount", F.sum("actual_payment_amount"))) if column in t.columns(P)}
    return an.anchors(t[P], "loan_id", {**measures, "payment_count": F.count(F.lit(1))}).withColumn(
        "side", F.lit("total"))


@relation("payment_marks", {P: ("loan_id",), L: ("loan_id",)}, "payment_id")
def payment_marks(t: Tables) -> DataFrame:
    """Payments, and below them the totals of each loan, with the marks they are held
    against: one pass over the loan tape and one join for all these rules.

    A loan with two origination dates meets its payments twice, as the rules ask.  Totals
    have no payment date and payments no totals, so a rule sees its own side only.
    """
    paid = t.project(P, _PAYMENT_MARK).withColumn("side", F.lit("payment"))
    both = paid.unionByName(_payment_totals(t), allowMissingColumns=True)
    if t.hot(P, "loan_id") or t.hot(L, "loan_id"):
        return skew_join(both, loan_marks(t), ["loan_id", "side"], "inner", t.hot(P, "loan_id"))
    # Marks lie by loan alone; an equality of the sides would be a key of the join and move them.
    marks = loan_marks(t).withColumnRenamed("side", "_side")
    return both.join(marks, "loan_id").filter("instr(side, _side) = 1").drop("_side")


@relation("loan_totals", {P: ("loan_id",), L: ("loan_id",)}, "loan_id")
def loan_totals(t: Tables) -> DataFrame:
    """Marks of a loan with its first payment dates and the sum paid."""
    return loan_marks(t, ("total",)).join(_payment_totals(t).drop("side"), "loan_id")


@relation("latest_snapshot", {L: ("loan_id", "snapshot_date"),
                              P: ("loan_id", "payment_status", "actual_payment_amount")}, "loan_id", "snapshot_date")
def latest_snapshot(t: Tables) -> DataFrame:
    """Rows of the newest snapshot date with the payment counts of their loan."""
    counts = an.anchors(t[P], "loan_id", {
        "payment_count": F.count(F.lit(1)),
        "paid_count": an.count_where("payment_status = 'POSTED' AND actual_payment_amount > 0")})
    # A loan without posted payments has no paid count, not a count of zero.
    counts = counts.withColumn("paid_count", F.when(F.col("paid_count") > 0, F.col("paid_count")))
    newest = an.at_latest(t.project(L, ["loan_id", "snapshot_date", "loan_status", "months_on_book"]),
                          "snapshot_date")
    return skew_join(newest, counts, "loan_id", "left", t.hot(L, "loan_id"))


@relation("payment_snapshot", {P: ("loan_id", "snapshot_date"), L: ("loan_id", "snapshot_date")}, "payment_id")
def payment_snapshot(t: Tables) -> DataFrame:
    """Payments with the loan snapshot of the same date; equal snapshots are folded."""
    loans = fold(t.project(L, ["loan_id", "snapshot_date", "current_principal_balance"]), "_n")
    paid = t.project(P, ["payment_id", "loan_id", "snapshot_date", "principal_paid"])
    return skew_join(paid, loans, ["loan_id", "snapshot_date"], "inner", t.hot(P, "loan_id"))


@relation("payment_before_snapshot", {P: ("loan_id", "snapshot_date"), L: ("loan_id", "snapshot_date")}, "payment_id")
def payment_before_snapshot(t: Tables) -> DataFrame:
    """Payments with the balance of the snapshot before the one of the same date."""
    loans = loan_steps(t).groupBy(
        "loan_id", "snapshot_date", F.col("prev_current_principal_balance").alias("opening_balance")).agg(
        F.sum("_n").alias("_m"))
    paid = t.project(P, ["payment_id", "loan_id", "snapshot_date", "principal_paid"])
    return skew_join(paid, loans, ["loan_id", "snapshot_date"], "inner", t.hot(P, "loan_id")
                     ).withColumnRenamed("_m", "_n")


def _interest(name: str, month: str, needs: tuple[str, ...]) -> None:
    @relation(name, {P: ("loan_id", "payment_due_date"), L: ("loan_id", *needs)}, "payment_id")
    def build(t: Tables) -> DataFrame:
        loans = fold(t[L].select("loan_id", F.expr(month).alias("due_month"), *[
            c for c in ("original_interest_rate",) if c in t.columns(L)]), "_n")
        paid = t.project(P, ["payment_id", "loan_id", "payment_due_date", "payment_status", "interest_paid",
                             "beginning_principal_balance"]).withColumn(
            "due_month", F.date_format("payment_due_date", "yyyy-MM"))
        return skew_join(paid, loans, ["loan_id", "due_month"], "inner", t.hot(P, "loan_id"))


_interest("payment_vintage_month", "vintage_month", ("vintage_month",))
_interest("payment_snapshot_month", "date_format(snapshot_date, 'yyyy-MM')", ("snapshot_date",))


@relation("snapshot_missed_depth", {L: ("loan_id", "snapshot_date", "loan_status"),
                                    P: ("loan_id", "payment_status", "payment_due_date")},
          "loan_id", "snapshot_date")
def snapshot_missed_depth(t: Tables) -> DataFrame:
    """Snapshots with the number of missed payments due up to their date.

    Both tables are reduced to (loan, date) counts and stacked, so a running sum gives
    the number of missed payments without pairing snapshots with payments.
    """
    late = ["DELINQUENT_30", "DELINQUENT_60", "DELINQUENT_90", "CHARGED_OFF"]
    snaps = fold(t[L].select("loan_id", F.col("snapshot_date").alias("on_date"), "loan_status")
                 .filter(F.col("loan_status").isin(late)), "_n").withColumn("_missed", F.lit(0).cast("long"))
    due = (t[P].filter("payment_status = 'MISSED'")
           .groupBy("loan_id", F.col("payment_due_date").alias("on_date"))
           .agg(F.count(F.lit(1)).alias("_missed"))
           .select("loan_id", "on_date", F.lit(None).cast("string").alias("loan_status"),
                   F.lit(0).cast("long").alias("_n"), "_missed"))
    # One row per loan, date and status: the window sees dates, not raw rows.
    upto = Window.partitionBy("loan_id").orderBy("on_date").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (snaps.unionByName(due).withColumn("missed_count", F.sum("_missed").over(upto))
            .filter("loan_status IS NOT NULL").withColumnRenamed("on_date", "snapshot_date").drop("_missed"))


# --- time order within a loan -----------------------------------------------------

_STEP = ["snapshot_date", "months_on_book", "days_past_due", "current_principal_balance", "loan_status"]


@relation("loan_steps", {L: ("loan_id", "snapshot_date")}, "loan_id", "snapshot_date")
def loan_steps(t: Tables) -> DataFrame:
    """Snapshots with the loan's previous snapshot (``prev_``) and its previous snapshot that
    was neither charged off nor paid off (``opened_``): one shuffle and sort for both."""
    values = [c for c in _STEP if c in t.columns(L)]
    also = {"opened_": "loan_status NOT IN ('CHARGED_OFF', 'PAID_OFF')"} if "loan_status" in values else {}
    return with_previous(t.project(L, ["loan_id", *values]), "loan_id", ["snapshot_date"], values,
                         t.hot(L, "loan_id"), also=also)


# --- keys, counts, parity ---------------------------------------------------------

@relation("application_keys", {A: ("application_id",)}, "application_id")
def application_keys(t: Tables) -> DataFrame:
    return ks.key_counts(t[A], "application_id")


@relation("snapshot_keys", {L: ("loan_id", "snapshot_date")}, "loan_id", "snapshot_date")
def snapshot_keys(t: Tables) -> DataFrame:
    return ks.key_counts(t[L], ["loan_id", "snapshot_date"])


@relation("primary_keys", {A: ("application_id",), L: ("loan_id", "snapshot_date")}, "table_name", "key_value")
def primary_keys(t: Tables) -> DataFrame:
    """Key groups of applications and of the loan tape, stacked."""
    apps = ks.key_counts(t[A], "application_id").select(
        F.lit(A).alias("table_name"), F.col("application_id").alias("key_value"), "copies")
    loans = ks.key_counts(t[L], ["loan_id", "snapshot_date"]).select(
        F.lit(L).alias("table_name"),
        F.concat_ws("|", "loan_id", F.col("snapshot_date").cast("string")).alias("key_value"), "copies")
    return apps.unionByName(loans)


@relation("identity_keys", {A: ("ssn_last4", "date_of_birth")}, "ssn_last4", "date_of_birth")
def identity_keys(t: Tables) -> DataFrame:
    return ks.key_counts(t[A], ["ssn_last4", "date_of_birth"])


@relation("loan_count_parity", {L: ("loan_id",), P: ("loan_id",)}, "n_left", "n_right")
def loan_count_parity(t: Tables) -> DataFrame:
    return ks.key_parity(t[L], t[P], "loan_id")


@relation("report_parity", {A: (), CR: ()}, "n_left", "n_right")
def report_parity(t: Tables) -> DataFrame:
    return ks.row_parity(t[A], t[CR])


@relation("fraud_parity", {A: (), FV: ()}, "n_left", "n_right")
def fraud_parity(t: Tables) -> DataFrame:
    return ks.row_parity(t[A], t[FV])


@relation("fraud_groups", {FV: ("application_id",)}, "application_id")
def fraud_groups(t: Tables) -> DataFrame:
    return ks.key_counts(t[FV], "application_id")


@relation("fraud_cardinality", {A: ("application_id",), FV: ("application_id",)}, "application_id")
def fraud_cardinality(t: Tables) -> DataFrame:
    return ks.cardinality(t[A], t[FV], "application_id")


@relation("dated_records", {A: ("application_date",), L: ("snapshot_date",), P: ("payment_received_date",)},
          "table_name", "record_date")
def dated_records(t: Tables) -> DataFrame:
    """The dates of three tables stacked, for one predicate over all of them."""
    parts = [t[n].select(F.lit(n).alias("table_name"), F.col(c).cast("date").alias("record_date"))
             for n, c in ((A, "application_date"), (L, "snapshot_date"), (P, "payment_received_date"))]
    return fold(reduce(DataFrame.unionByName, parts))


# --- aggregates judged as a whole -------------------------------------------------

@relation("vintage_rolls", {L: ("vintage_month", "loan_status")}, "vintage_month")
def vintage_rolls(t: Tables) -> DataFrame:
    counts = t[L].groupBy("vintage_month").agg(*[
        F.count_if(F.col("loan_status") == f"DELINQUENT_{d}").alias(f"count_{d}") for d in (30, 60, 90)])
    return counts.withColumns({
        "roll_30_to_60": F.try_divide(F.col("count_60") * 100.0, F.col("count_30")),
        "roll_60_to_90": F.try_divide(F.col("count_90") * 100.0, F.col("count_60"))})


@relation("vintage_chargeoffs", {L: ("vintage_year", "months_on_book", "chargeoff_flag")}, "vintage_year")
def vintage_chargeoffs(t: Tables) -> DataFrame:
    return t[L].filter("months_on_book >= 12").groupBy("vintage_year").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.try_divide(F.sum("chargeoff_flag") * 100.0, F.count(F.lit(1))).alias("chargeoff_rate"))


@relation("inquiry_trend", {CR: ("inquiries_6mo_count", "fico_score_8")}, "pairs")
def inquiry_trend(t: Tables) -> DataFrame:
    return pf.correlation(t[CR], "inquiries_6mo_count", "fico_score_8")


@relation("utilization_trend", {CR: ("revolving_utilization_ratio", "fico_score_8")}, "pairs")
def utilization_trend(t: Tables) -> DataFrame:
    return pf.correlation(t[CR], "revolving_utilization_ratio", "fico_score_8")


@relation("fraud_score_spread", {FV: ("overall_fraud_score",)}, "value_count")
def fraud_score_spread(t: Tables) -> DataFrame:
    return pf.dispersion(t[FV], "overall_fraud_score")


@relation("bank_volume", {BT: ("application_id",)}, "total_rows")
def bank_volume(t: Tables) -> DataFrame:
    """Rows and distinct applications (null left out), from one count per application."""
    per_app = ks.key_counts(t[BT], "application_id")
    return per_app.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
                       F.count("application_id").alias("applications"))


@relation("null_rates", {}, "table_name", "column_name")
def null_rates(t: Tables) -> DataFrame:
    """Null percentage of every column of every table; keys and dates are critical."""
    parts = [pf.null_profile(t[n]).withColumn("table_name", F.lit(n)) for n in t]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("critical", F.expr(
        "column_name IN ('application_id', 'loan_id', 'customer_id', 'payment_id', 'credit_report_id', "
        "'tradeline_id', 'transaction_id') OR column_name IN ('application_date', 'decision_date', "
        "'date_of_birth', 'fico_score_at_application', 'snapshot_date', 'origination_date', 'first_payment_due_date', 'payment_due_date', "
        "'report_date')"))


@relation("schema_differences", {}, "table_name", "column_name")
def schema_differences(t: Tables) -> DataFrame:
    """Declared columns of the lending model against the columns present."""
    parts = [pf.schema_gaps(t[n], t.declared[n], n) for n in t if n in t.declared]
    return reduce(DataFrame.unionByName, parts) if parts else t.spark.createDataFrame(
        [], "table_name string, column_name string, gap string")
