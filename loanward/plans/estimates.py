"""What a sampled run says about all rows: violations scaled up, with an interval.

A sample keeps whole families (an application with its loans, payments, reports and checks), each with the same
probability. What a family adds to a rule's count is therefore one observation, however many rows it has: the variance
comes from families and not from rows, which rarely are independent.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.functions.sqltext import literal, over
from loanward.operators.skew import skew_join
from loanward.plans.evaluate import Plan
from loanward.plans.relations import RELATIONS
from loanward.plans.rule import SKIP, Rule
from loanward.sources.tables import Tables, sample_tables

#: Where a family is looked up by rows that don't name their application.
PARENTS = {"loan_id": "loan_tape", "credit_report_id": "credit_reports"}
#: Standard deviations on either side: 95 % of normal estimates.
WIDTH = 1.96

_ESTIMATE = """
SELECT rule_id, variant, sampled, estimate, low, high,
  CASE WHEN mode = 'info' OR mode = 'band' THEN 'INFO'
       WHEN mode = 'limit' THEN CASE WHEN low > allowed THEN 'FAIL' WHEN high <= allowed THEN 'PASS' ELSE 'OPEN' END
       WHEN mode = 'floor_le' AND (high <= minimum OR over_high <= 0) OR mode = 'strict_lt' AND over_high < 0 THEN 'PASS'
       WHEN mode = 'floor_le' AND low > minimum AND over_low > 0 OR mode = 'strict_lt' AND over_low >= 0 THEN 'FAIL'
       ELSE 'OPEN' END AS status
FROM (
  SELECT *, greatest(CAST(sampled AS DOUBLE), estimate - {width} * deviation) AS low,
    IF(sampled = 0, none, estimate + {width} * deviation) AS high,
    over_ - {width} * over_deviation AS over_low, over_ + {width} * over_deviation AS over_high
  FROM (
    SELECT rule_id, variant, mode, allowed, minimum, CAST(sum(y) AS BIGINT) AS sampled,
      sum(IF(family IS NULL, y, y / {p})) AS estimate,
      sqrt(sum(IF(family IS NULL, 0D, {q} * y * y))) / {p} AS deviation,
      sum(IF(family IS NULL, z, z / {p})) AS over_,
      sqrt(sum(IF(family IS NULL, 0D, {q} * z * z))) / {p} AS over_deviation, CAST({none} AS DOUBLE) AS none
    FROM (SELECT *, y - share * b AS z FROM {families})
    GROUP BY rule_id, variant, mode, allowed, minimum))
"""


def _with_family(plan: Plan, name: str) -> DataFrame | None:
    """A relation's rows with the family that they belong to; None where they have no key that leads to one.

    Rows whose parent is absent are in every sample, so they have no family and are counted as they are.
    """
    frame, tables = plan.frame(name), plan.tables
    if "application_id" in frame.columns:
        return frame.withColumn("_family", F.col("application_id").cast("string"))
    for key, parent in PARENTS.items():
        if key in frame.columns and {key, "application_id"} <= set(tables.columns(parent)):
            families = tables[parent].groupBy(key).agg(F.min("application_id").cast("string").alias("_family"))
            own = next((t for t in ("payments", "credit_tradelines", parent) if key in tables.columns(t)), parent)
            return skew_join(frame, families, key, "left", tables.hot(own, key))
    return None


def _family_sums(frame: DataFrame, cells: list[str], keys: list[tuple[Rule, str, str]]) -> DataFrame:
    """Rows (family, rule, y, b): what each family adds to a rule's count and to its base."""
    sums = over({"frame": frame}, f"SELECT _family AS family, {', '.join(cells)} FROM {{frame}} GROUP BY _family")
    structs = ", ".join(f"struct({literal(r.id)} AS rule_id, {literal(r.variant)} AS variant, coalesce({c}, 0D) * {float(target == 'y')}D AS y, "
                        f"coalesce({c}, 0D) * {float(target == 'b')}D AS b)" for r, target, c in keys)
    return over({"sums": sums}, f"SELECT family, inline(array({structs})) FROM {{sums}}")


def estimates(rules: Iterable[Rule], tables: Tables, fraction: float, seed: int = 7, width: float = WIDTH,
              relations=RELATIONS) -> DataFrame:
    """rule_id, variant, sampled, estimate, low, high, status of rules, from a sample of the families.

    ``estimate`` is the number of violations in all rows, ``low`` and ``high`` hold it between ``width`` standard
    deviations; it is never under what was seen. A rule without a sampled violation has ``high`` as the number of
    violating families that such a sample misses with the same small probability, its rows being unknown. ``status`` is
    PASS or FAIL if the whole interval is on one side of the tolerance, else OPEN; a share is judged by the
    difference of each family's violations and its share of the base, so the base's own error counts. Rates and information are INFO.

    SKIP: rules whose input is absent, whose rows name no application, loan or report (their count doesn't add up over
    families, as with parities), and bases without one. Rows of payments or tradelines without parent are in every
    sample and counted as they are; other rows without application id are not sampled. A loan under several
    applications is counted with the least one sampled. Empty tables give 0 with the bound above.
    """
    sample = sample_tables(tables, fraction, seed)
    plan = Plan(sample, relations)
    rules = [r.at(tables.as_of) for r in rules]
    reasons = {place: plan.skip_reason(r) for place, r in enumerate(rules)}
    ready = [place for place in reasons if reasons[place] is None]
    unresolved = plan.unresolved([rules[p] for p in ready])
    ready = [p for at, p in enumerate(ready) if at not in unresolved]
    framed: dict[str, DataFrame | None] = {}

    def frame(name: str) -> DataFrame | None:
        if name not in framed:
            framed[name] = _with_family(plan, name)
        return framed[name]

    sums: dict[str, tuple[list[str], list[tuple[Rule, str, str]]]] = {}
    parts, judged = [], []

    def add(name: str, rule: Rule, target: str, amount: str) -> None:
        cells, keys = sums.setdefault(name, ([], []))
        cells.append(f"CAST(sum({amount}) AS DOUBLE) AS c{len(cells)}")
        keys.append((rule, target, f"c{len(cells) - 1}"))

    for place in ready:
        rule = rules[place]
        base = None
        if rule.tolerance.mode in ("floor_le", "strict_lt"):
            base = (rule.base.relation, rule.base.where) if rule.base else (rule.relation, "TRUE")
        if frame(rule.relation) is None or base and frame(base[0]) is None:
            continue
        judged.append(place)
        weight = f"CAST({rule.weight} AS BIGINT) * _n" if rule.weight else "_n"
        if rule.distinct:
            parts.append(over({"frame": frame(rule.relation)}, f"""
                SELECT family, {literal(rule.id)} AS rule_id, {literal(rule.variant)} AS variant, CAST(count(k) AS DOUBLE) AS y, 0D AS b
                FROM (SELECT DISTINCT _family AS family, {rule.distinct} AS k FROM {{frame}} WHERE {rule.predicate}) GROUP BY family"""))
        else:
            add(rule.relation, rule, "y", f"CASE WHEN {rule.predicate} THEN {weight} END")
        if base:
            add(base[0], rule, "b", f"CASE WHEN {base[1]} THEN _n END")
    for name, (cells, keys) in sums.items():
        parts.append(_family_sums(frame(name), cells, keys))
    spark = tables.spark
    schema = "rule_id string, variant string, sampled long, estimate double, low double, high double, status string"
    skipped = spark.createDataFrame([(r.id, r.variant, -1, None, None, None, SKIP) for p, r in enumerate(rules) if p not in judged], schema)
    if not judged:
        return skipped
    modes = spark.createDataFrame(
        [(rules[p].id, rules[p].variant, rules[p].tolerance.mode, float(rules[p].tolerance.limit), float(rules[p].tolerance.share),
          float(rules[p].tolerance.minimum)) for p in judged],
        "rule_id string, variant string, mode string, allowed double, share double, minimum double")
    families = reduce(DataFrame.unionByName, parts).groupBy("family", "rule_id", "variant").agg(F.sum("y").alias("y"), F.sum("b").alias("b"))
    # One row per rule: a rule of empty tables has no family and still is listed.
    listed = modes.join(families, ["rule_id", "variant"], "left").fillna(0.0, ["y", "b"])
    miss = math.erfc(width / math.sqrt(2))
    none = 0.0 if fraction >= 1 else math.ceil(math.log(miss) / math.log(1 - fraction))
    text = _ESTIMATE
    for name, value in (("p", repr(float(fraction)) + "D"), ("q", repr(float(1 - fraction)) + "D"), ("width", repr(float(width)) + "D"), ("none", repr(float(none)))):
        text = text.replace("{" + name + "}", value)
    return over({"families": listed}, text).unionByName(skipped)
