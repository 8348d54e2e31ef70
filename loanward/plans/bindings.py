"""The 35 rule kinds bound to the star-schema tables.

Each binding shows a kind on tables it was not written for: the operators take any
frame, key and predicate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanward.functions.finance import installment
from loanward.operators import anchors as an
from loanward.operators import keys as ks
from loanward.operators import profile as pf
from loanward.operators.joins import joined
from loanward.operators.pairs import Meeting, match_counts
from loanward.operators.skew import skew_join, unfold, with_previous
from loanward.sources.tables import Tables, size_shuffles

KINDS: dict[str, Callable[[Tables], DataFrame]] = {}

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def star_tables(spark: SparkSession, sf_dir: str, **options) -> Tables:
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in STAR_TABLES}
    size_shuffles(frames.values())
    return Tables(frames, **options)


def kind(name: str):
    def register(build):
        KINDS[name] = build
        return build
    return register


def _per(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("violations"))


def _lines(t: Tables) -> DataFrame:
    return t["lineitem"]


@kind("k01_foreign_key_orphan")
def k01(t: Tables) -> DataFrame:
    """Line items without an order, and user ids of events without a customer."""
    lines = ks.orphan_counts(_lines(t), t["orders"], "l_orderkey", "o_orderkey")
    events = ks.orphan_counts(t["events"], t["customer"], "user_id", "c_custkey")
    pages = ks.orphan_counts(t["documents"], t["labels"], "doc_id")
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("child"), F.col(key).alias("key_value"), "violations")
        for name, df, key in (("lineitem", lines, "l_orderkey"), ("events", events, "user_id"),
                              ("documents", pages, "doc_id"))])


@kind("k02_conditional_existence")
def k02(t: Tables) -> DataFrame:
    filled = t["orders"].filter("o_orderstatus = 'F'")
    return ks.orphans(filled, _lines(t), "o_orderkey", "l_orderkey",
                      t.hot("orders", "o_orderkey")).select("o_orderkey", "o_custkey")


@kind("k03_joined_predicate")
def k03(t: Tables) -> DataFrame:
    """Line items shipped before their order date, per order."""
    orders = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    both = skew_join(_lines(t).select("l_orderkey", "l_shipdate"), orders, "l_orderkey", "inner",
                     t.hot("lineitem", "l_orderkey"))
    return _per(both.filter("l_shipdate < o_orderdate"), "l_orderkey")


@kind("k03_pair_counts")
def k03_pairs(t: Tables) -> DataFrame:
    """Events before orders of the same customer, per customer: both sides repeat the key, and no pair is made."""
    orders = t["orders"].select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderstatus")
    tests = {"before": [Meeting("event_type = 'purchase'", "o_orderstatus = 'F'", "ts", "<", "o_orderdate")],
             "after": [Meeting("event_type = 'purchase'", "o_orderstatus = 'F'", "ts", ">=", "o_orderdate")]}
    return match_counts(t["events"], orders, "user_id", tests, ["user_id"])


@kind("k04_row_predicate")
def k04(t: Tables) -> DataFrame:
    return t["customer"].filter("c_acctbal < 0").select("c_custkey", "c_acctbal")


@kind("k05_range")
def k05(t: Tables) -> DataFrame:
    return _per(_lines(t).filter("NOT (l_discount BETWEEN 0.01D AND 0.09D)"), "l_orderkey", "l_linenumber")


@kind("k06_enumeration")
def k06(t: Tables) -> DataFrame:
    known = ("signup", "click", "view", "purchase")
    return t["events"].filter(~F.col("event_type").isin(*known)).select("event_id", "event_type")


@kind("k07_cross_column")
def k07(t: Tables) -> DataFrame:
    return _per(_lines(t).filter("l_extendedprice > 2000 * l_quantity"), "l_orderkey", "l_linenumber")


@kind("k08_reconciliation")
def k08(t: Tables) -> DataFrame:
    """Orders whose total differs from their line items by more than 1000."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = an.anchors(_lines(t), "l_orderkey", {"net": F.sum(net)})
    both = t["orders"].join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    gap = F.abs(F.col("net") - F.col("o_totalprice"))
    return both.filter(gap > 1000).select("o_orderkey", F.round(gap, 4).alias("difference"))


@kind("k09_text_format")
def k09(t: Tables) -> DataFrame:
    return t["pages"].filter(~F.col("url").rlike("^https://")).select(
        "page_id", F.octet_length("url").alias("url_bytes"))


@kind("k10_conditional_not_null")
def k10(t: Tables) -> DataFrame:
    """English documents whose quality label is absent."""
    labels = t["labels"].groupBy("doc_id").agg(F.max("quality").alias("quality"))
    english = t["documents"].filter("lang = 'en'").select("doc_id", "lang")
    return skew_join(english, labels, "doc_id", "left", t.hot("documents", "doc_id")).filter(
        "quality IS NULL").select("doc_id")


@kind("k11_event_after_anchor")
def k11(t: Tables) -> DataFrame:
    last = an.anchors(t["events"].filter("event_type = 'signup'"), "user_id", {"last_signup": F.max("ts")})
    bought = t["events"].filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return skew_join(bought, last, "user_id", "inner", t.hot("events", "user_id")).filter(
        "ts > last_signup").select("event_id", "user_id")


@kind("k12_first_event_against_dimension")
def k12(t: Tables) -> DataFrame:
    first = an.anchors(_lines(t), "l_orderkey", {"first_ship": F.min("l_shipdate")})
    return t["orders"].join(first, F.col("o_orderkey") == F.col("l_orderkey")).filter(
        "first_ship < o_orderdate").select(
        "o_orderkey", F.datediff("o_orderdate", "first_ship").alias("days_early"))


@kind("k13_group_sum_against_cap")
def k13(t: Tables) -> DataFrame:
    total = an.anchors(_lines(t), "l_orderkey", {"total": F.sum("l_extendedprice")})
    return t["orders"].join(total, F.col("o_orderkey") == F.col("l_orderkey")).filter(
        "total > 3 * o_totalprice").select("o_orderkey", F.round("total", 2).alias("total"))


def _event_steps(t: Tables) -> DataFrame:
    rows = t["events"].select("user_id", "ts", "event_id", "event_type", "value")
    return with_previous(rows, "user_id", ["ts", "event_id"], ["ts", "event_id", "event_type", "value"],
                         t.hot("events", "user_id"))


@kind("k14_terminal_state")
def k14(t: Tables) -> DataFrame:
    """Users with another kind of event right after a purchase."""
    return _event_steps(t).filter("prev_event_type = 'purchase' AND event_type <> 'purchase'").groupBy(
        "user_id").agg(F.sum("_n").alias("violations"))


@kind("k15_monotonic_measure")
def k15(t: Tables) -> DataFrame:
    return unfold(_event_steps(t).filter("value > prev_value + 1.0D").select(
        "event_id", "user_id", "prev_value", "value", "_n"))


@kind("k16_sequence_gap")
def k16(t: Tables) -> DataFrame:
    rows = t["orders"].select("o_custkey", "o_orderdate", "o_orderkey")
    steps = with_previous(rows, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderdate", "o_orderkey"],
                          t.hot("orders", "o_custkey"))
    gap = F.datediff("o_orderdate", "prev_o_orderdate")
    return unfold(steps.withColumn("gap", gap).filter("gap > 365 OR gap < 7").select(
        "o_orderkey", "o_custkey", "gap", "_n"))


@kind("k17_latest_snapshot")
def k17(t: Tables) -> DataFrame:
    """Orders of the newest month with the order count of their customer."""
    counts = ks.key_counts(t["orders"], "o_custkey", "order_count")
    newest = an.in_latest_month(t["orders"], "o_orderdate").select(
        "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return skew_join(newest, counts, "o_custkey", "left", t.hot("orders", "o_custkey"))


@kind("k18_key_uniqueness")
def k18(t: Tables) -> DataFrame:
    return ks.surplus_rows(_lines(t), ["l_orderkey", "l_linenumber"])


@kind("k19_row_parity")
def k19(t: Tables) -> DataFrame:
    return ks.row_parity(t["documents"], t["labels"]).withColumn(
        "violations", F.abs(F.col("n_left") - F.col("n_right")))


@kind("k20_key_parity")
def k20(t: Tables) -> DataFrame:
    gap = F.abs(F.col("n_left") - F.col("n_right"))
    return ks.key_parity(t["orders"], _lines(t), "o_orderkey", "l_orderkey").withColumn(
        "violations", F.when(gap > 100, gap).otherwise(F.lit(0)))


@kind("k21_one_to_one")
def k21(t: Tables) -> DataFrame:
    return ks.cardinality(t["documents"], t["labels"], "doc_id").filter("children <> 1")


@kind("k22_cross_table_value")
def k22(t: Tables) -> DataFrame:
    """Line items whose customer and supplier live in different nations, per nation pair.

    Line items are folded to (order, supplier) counts before they meet the dimensions.
    """
    pairs = ks.key_counts(_lines(t), ["l_orderkey", "l_suppkey"], "_n")
    orders = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = t["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    suppliers = t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    buyers = skew_join(orders, customers, "o_custkey", "inner", t.hot("orders", "o_custkey"))
    filled = skew_join(pairs, buyers, "l_orderkey", "inner", t.hot("lineitem", "l_orderkey"))
    both = skew_join(filled, suppliers, "l_suppkey", "inner",
                     t.hot("lineitem", "l_suppkey"))
    return both.filter("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(
        F.sum("_n").alias("violations"))


@kind("k22_pair_counts")
def k22_pairs(t: Tables) -> DataFrame:
    """Customers against suppliers of their nation, per segment: balances, and names that differ."""
    customers = t["customer"].select(F.col("c_nationkey").alias("nation"), "c_acctbal", "c_mktsegment", "c_name")
    suppliers = t["supplier"].select(F.col("s_nationkey").alias("nation"), "s_acctbal", "s_name")
    tests = {"poorer": [Meeting(left="c_acctbal", op="<", right="s_acctbal")],
             "far": [Meeting(left="c_acctbal", op="<", right="s_acctbal - 5000"), Meeting(left="c_acctbal", op=">", right="s_acctbal + 5000")],
             "other_name": [Meeting("c_acctbal > 0", left="c_name", op="<>", right="s_name")], "pairs": [Meeting()]}
    return match_counts(customers, suppliers, "nation", tests, ["c_mktsegment"])


@kind("k23_rate_in_band")
def k23(t: Tables) -> DataFrame:
    out = pf.rate(t["events"], "event_type = 'purchase'")
    return out.select("matching", "total", F.round("pct", 6).alias("pct"),
                      F.when(F.col("pct").between(15, 25), "PASS").otherwise("WARN").alias("status"))


@kind("k24_distribution")
def k24(t: Tables) -> DataFrame:
    return pf.histogram(t["orders"], pf.bucketed("o_totalprice", 50000.0).cast("long"), "bucket")


@kind("k25_bucketed_mean")
def k25(t: Tables) -> DataFrame:
    out = pf.bucket_means(_lines(t), pf.bucketed("l_quantity", 10.0).cast("long"), "l_extendedprice", "bucket")
    return out.withColumn("avg_l_extendedprice", F.round("avg_l_extendedprice", 4))


@kind("k25_correlation")
def k25c(t: Tables) -> DataFrame:
    return pf.correlation(_lines(t), "l_quantity", "l_extendedprice").select(
        F.round("correlation", 8).alias("correlation"), "pairs")


@kind("k26_cohort_rate")
def k26(t: Tables) -> DataFrame:
    out = pf.group_rates(t["orders"], [F.date_format("o_orderdate", "yyyy-MM").alias("cohort")],
                         {s.lower(): f"o_orderstatus = '{s}'" for s in "FOP"})
    return out.select("cohort", "row_count", "f_count", "o_count", "p_count",
                      *[F.round(f"{s}_pct", 6).alias(f"{s}_pct") for s in "fop"])


@kind("k27_null_profile")
def k27(t: Tables) -> DataFrame:
    """Nulls per column of the documents with their labels attached."""
    labels = t["labels"].groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # Only whether a value is there goes through the join, not the text.
    documents = t["documents"].select("doc_id", *[F.when(F.col(c).isNotNull(), F.lit(1)).alias(c)
                                                  for c in t.columns("documents") if c != "doc_id"])
    both = skew_join(documents, labels, "doc_id", "left", t.hot("documents", "doc_id"))
    out = pf.null_profile(both)
    return out.withColumn("null_pct", F.round("null_pct", 6))


@kind("k28_predicate_over_tables")
def k28(t: Tables) -> DataFrame:
    """Dates after 1 July 2000 in three tables."""
    parts = [t[n].filter(F.col(c) > F.lit("2000-07-01").cast("timestamp")).agg(
        F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("table_name"), "violations")
        for n, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    return reduce(DataFrame.unionByName, parts)


@kind("k29_duplicate_groups")
def k29(t: Tables) -> DataFrame:
    return ks.duplicate_groups(_lines(t), ["l_orderkey", "l_linenumber"])


@kind("k30_amortization")
def k30(t: Tables) -> DataFrame:
    """Line items whose price is more than 5000 off the installment of their order total."""
    orders = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    rows = skew_join(_lines(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_extendedprice"),
                     orders, "l_orderkey", "inner", t.hot("lineitem", "l_orderkey"))
    expected = installment("o_totalprice", "l_tax", 12 * (1 + F.col("l_partkey") % 6))
    return rows.filter(F.abs(F.col("l_extendedprice") - expected) > 5000).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("violations"), F.round(F.max(expected), 6).alias("largest_installment"))


@kind("k31_dispersion")
def k31(t: Tables) -> DataFrame:
    out = pf.dispersion(t["events"], "value")
    return out.select("value_count", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"),
                      "minimum", "maximum")


@kind("k32_flag_against_existence")
def k32(t: Tables) -> DataFrame:
    flagged = t["customer"].filter("c_acctbal < 0").select("c_custkey", "c_acctbal")
    large = t["orders"].filter("o_totalprice > 490000")
    return ks.holders(flagged, large, "c_custkey", "o_custkey", t.hot("customer", "c_custkey"))


#: Columns declared for three of the tables, one of them absent in each.
DECLARED = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_clerk"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_phone"),
    "labels": ("doc_id", "quality", "toxic", "source"),
}


@kind("k33_schema_exhaustiveness")
def k33(t: Tables) -> DataFrame:
    """Declared columns, whether they are present, and how many values they hold."""
    parts = [pf.declared_profile(t[name], declared).withColumn("table_name", F.lit(name))
             for name, declared in DECLARED.items()]
    return reduce(DataFrame.unionByName, parts)


@kind("k34_age_at_event")
def k34(t: Tables) -> DataFrame:
    """Line items shipped more than three years after their order."""
    orders = t["orders"].select("o_orderkey", "o_orderdate").withColumnRenamed("o_orderkey", "l_orderkey")
    rows = joined(_lines(t).select("l_orderkey", "l_shipdate"), orders, "l_orderkey", "", t.hot("lineitem", "l_orderkey"))
    age = F.datediff("l_shipdate", "o_orderdate") / F.lit(365.25)
    return rows.filter(age > 3).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("violations"), F.round(F.max(age), 6).alias("oldest"))


@kind("k35_token_count")
def k35(t: Tables) -> DataFrame:
    """Documents in which the token occurs more than ten times, over the whole text."""
    tokens = F.regexp_count(F.lower("text"), F.lit("the"))
    return t["documents"].select("doc_id", tokens.alias("tokens")).filter("tokens > 10")
