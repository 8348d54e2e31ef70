"""Operator 10: quality rules with host verdicts, in DataFrame functions only.

Rules on each text give a base verdict. Failures are counted by domain, a beta prior is estimated from all
domains, each domain's failure rate is shrunk towards it, and domains whose shrunk rate is too high are joined
back to their documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.llm.common import Scratch, column_or_null

MIN_WORDS = 50
#: Percent of words in repeated 3-word windows above which a text fails.
MAX_REPEATED = 50
#: Shrunk failure rate above which a whole domain is rejected.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight, in documents.
WEIGHT = (1.0, 1e6)
#: Rejected or not, a domain list up to this many rows is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
_SPACES = " \t\n\x0b\x0c\r"
_SPLIT = r"[\x20\x09-\x0D]+"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_metrics(documents: DataFrame, carry: Sequence[str], domain: str) -> DataFrame:
    """``row`` (a struct of the carried columns), ``domain``, the five base figures and base_failed.

    A null text has no words, lines or symbols. Long texts cost n log n; nothing is shuffled.
    """
    text = F.coalesce(column_or_null(documents, "text", "string"), F.lit(""))
    words = F.filter(F.split(text, _SPLIT), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        column_or_null(documents, domain, "string").alias("domain"),
        words.alias("words"), lines.alias("lines"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}).drop("lines")
    # 3-word windows as 64-bit hashes.
    windows = F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    rows = rows.withColumn("windows", windows).drop("words")
    # Only texts with a repeated window are sorted: equal windows then stand side by side.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(repeats, F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    twice = F.filter("sorted", lambda e, k: (
        F.coalesce(F.get("sorted", k - 1)["h"] == e["h"], F.lit(False))
        | F.coalesce(F.get("sorted", k + 1)["h"] == e["h"], F.lit(False))))
    rows = rows.withColumn("places", F.sort_array(F.transform(twice, lambda e: e["i"]))).drop("sorted")
    covered = F.aggregate(
        "places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")),
        lambda a: a["n"].cast("long"))
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.select("row", "domain", *METRICS, failed.alias("base_failed"))


def host_rates(rows: DataFrame) -> DataFrame:
    """domain, n, failed, host_rate: each domain's failure rate shrunk by a beta prior fitted to all domains.

    The prior has the pooled rate as its mean and the spread of the domains' rates as its variance; without
    spread its weight is the upper bound. A null domain is a domain of its own.
    """
    hosts = rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    prior = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"),
                      F.var_pop(F.col("failed") / F.col("n")).alias("spread")).first()  # one row
    mean = (prior["failed"] or 0) / (prior["n"] or 1)
    weight = WEIGHT[1] if not prior["spread"] else mean * (1 - mean) / prior["spread"] - 1
    weight = min(max(weight, WEIGHT[0]), WEIGHT[1])
    return hosts.withColumn(
        "host_rate", (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)))


def judge(documents: DataFrame, domain: str = "source", limit: float = HOST_LIMIT,
          carry: Sequence[str] | None = None) -> DataFrame:
    """The carried columns (all by default), the base figures, base_failed, host_rate and kept.

    Columns that have the names of the added ones are replaced. A row is kept if it passes the base rules and
    its domain's shrunk failure rate is at most ``limit``. Equal rows get equal verdicts. A frame without the
    domain column is one domain.
    """
    added = (*METRICS, "base_failed", "host_rate", "kept")
    carry = [c for c in (documents.columns if carry is None else carry) if c.lower() not in added]
    scratch = Scratch(documents.sparkSession, "quality")
    rows = scratch.put("rows", with_metrics(documents, carry, domain))
    hosts = scratch.put("hosts", host_rates(rows)).withColumnRenamed("domain", "host")
    if hosts.count() <= BROADCAST_ROWS:  # one narrow row per domain
        hosts = F.broadcast(hosts)
    return rows.join(hosts, F.col("domain").eqNullSafe(F.col("host")), "left").select(
        *[F.col(f"row.`{c}`") for c in carry], *METRICS, "base_failed", "host_rate",
        (~F.col("base_failed") & (F.col("host_rate") <= limit)).alias("kept"))
