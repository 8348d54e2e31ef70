"""Drill-down of a whole pack: the worst offenders of every rule in one plan."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanward.functions.sqltext import literal, over
from loanward.plans.evaluate import FEW, Plan, kept
from loanward.plans.relations import RELATIONS
from loanward.plans.rule import FAIL, Rule
from loanward.sources.tables import Tables

#: Rules that share one scan; the matched ones are put beside the row.
RULES_PER_PASS = 30

_RANKED = """
SELECT DISTINCT names[rule].rule_id AS rule_id, names[rule].variant AS variant, CAST(place AS BIGINT) AS place, who, excess, violations
FROM (SELECT *, array({names}) AS names
      FROM (SELECT rule, who, excess, violations,
                   dense_rank() OVER (PARTITION BY rule ORDER BY excess DESC NULLS LAST, violations DESC, who) AS place
            FROM {found})
      WHERE place <= {limit})
"""

#: Offenders that come in several parts, put together by name.
_MERGED = """
SELECT rule, who, max(excess) AS excess, IF(max(once), 1L, sum(violations)) AS violations, max(once) AS once
FROM {found} GROUP BY rule, who
"""


def _who(keys: Sequence[str]) -> str:
    parts = ", ".join(f"concat('{k}=', coalesce(CAST({k} AS STRING), 'null'))" for k in keys)
    return f"concat_ws(', ', {parts})"


def _grain(frame: DataFrame, keys: Sequence[str]) -> dict[str, str]:
    """Expressions by name that are equal for rows of one name and for no others; narrower than the name itself.

    Null and the text ``null`` have one name. Where several keys are text, only the name tells which names are equal.
    """
    kinds = {k: frame.schema[k].dataType for k in keys}
    texts = [k for k in keys if not isinstance(kinds[k], (T.DateType, T.IntegralType))]
    if len(texts) > 1 or any(not isinstance(kinds[k], T.StringType) for k in texts):
        return {"who": _who(keys)}
    return {k: f"coalesce({k}, 'null')" if k in texts else k for k in keys}


def _numbers(rules) -> str:
    return ", ".join(map(str, rules))


def _offenders(frame: DataFrame, rules: Mapping[int, Rule], keys: Sequence[str], excess: Mapping[str, str]) -> DataFrame:
    """rule (its number), who, excess, violations, once: a row for every rule and its offender, told by the keys.

    Rows are put together by key with a column for each rule, and become a row for each violated rule behind that:
    a row that violates many rules moves once. An offender of a rule that counts one of several keys comes once for
    each of its values of the others, in equal rows.
    """
    grain = _grain(frame, keys)
    sums, cells = [], []
    for n, r in rules.items():
        amount = f"CAST({r.weight} AS BIGINT) * _n" if r.weight else "_n"
        sums.append(f"max(CASE WHEN {r.predicate} THEN 1L END) AS v{n}" if r.distinct
                    else f"sum(CASE WHEN {r.predicate} THEN CAST({amount} AS BIGINT) END) AS v{n}")
        if r.id in excess:
            sums.append(f"max(CASE WHEN {r.predicate} THEN CAST({excess[r.id]} AS DOUBLE) END) AS e{n}")
        worst = f"round(e{n}, 6)" if r.id in excess else "CAST(NULL AS DOUBLE)"
        cells.append(f"CASE WHEN v{n} > 0 THEN struct({n} AS rule, {worst} AS excess, v{n} AS violations, "
                     f"{'TRUE' if r.distinct else 'FALSE'} AS once) END")
    some = "FALSE OR " + " OR ".join(f"({r.predicate})" for r in rules.values())
    one = {r.distinct: _numbers(m for m, o in rules.items() if o.distinct == r.distinct)
           for r in rules.values() if r.distinct and [r.distinct] != list(keys)}
    cases = "".join(f"WHEN rule IN ({own}) THEN {_who([k])} " for k, own in one.items())
    named = "who" if "who" in grain else f"CASE {cases}ELSE {_who(keys)} END AS who" if cases else f"{_who(keys)} AS who"
    return over({"frame": frame}, f"""
        SELECT rule, {named}, excess, violations, once
        FROM (SELECT {', '.join(grain)}, inline(array({', '.join(cells)}))
              FROM (SELECT {', '.join(f'{e} AS {k}' for k, e in grain.items())}, {', '.join(sums)}
                    FROM {{frame}} WHERE {some} GROUP BY {', '.join(grain.values())}))
        WHERE rule IS NOT NULL""")


def worst_offenders(rules: Iterable[Rule], tables: Tables, excess: Mapping[str, str] | None = None, limit: int = 10,
                    results: DataFrame | None = None, relations=RELATIONS, apart: bool = False) -> DataFrame:
    """rule_id, variant, place, who, excess, violations: the ``limit`` worst offenders of every rule, a top-k report.

    Who is bad is told by the relation's identity, ``name=value`` (null: ``null``), or by the key that the rule counts.
    Worse is who has a higher ``excess`` (a SQL expression by rule id over the relation, the highest of an offender's
    rows), then who has more violations; equal ones come in the order of their text. Rules without an excess go by
    violations, and under keys that both sides of their join repeat the pairs are counted and not made. ``results`` are
    judged rows: with them only rules that fail are listed. Rules that can't run, and empty tables, give no rows.

    Each relation is read once for up to ``RULES_PER_PASS`` rules that tell who is bad by the same keys. Its rows are
    put together by these keys, on the map side first, and every task keeps its ``limit`` worst per rule before these meet.
    With ``apart`` the worst of each pass are found at once, by a job of its own, and kept, ``limit`` rows a rule: the
    disk holds what one pass shuffles, not what all do.
    """
    # A method that tests many rules on derived columns is beyond what the JVM compiles (8,000 bytes) and would be
    # interpreted row by row; beyond this limit Spark generates several smaller ones.
    tables.spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
    plan, excess = Plan(tables, relations), dict(excess or {})
    ready = [r for r in (rule.at(tables.as_of) for rule in rules) if plan.skip_reason(r) is None]
    unresolved = plan.unresolved(ready)
    frames: dict[tuple[str, str, tuple[str, ...]], list[Rule]] = defaultdict(list)
    counted: dict[str, dict[str, Rule]] = defaultdict(dict)
    numbers: dict[tuple[str, str], int] = {}
    split = set()  # rules whose offenders come in several parts
    for place, rule in enumerate(ready):
        if place in unresolved:
            continue
        if (rule.id, rule.variant) in numbers:
            split.add(numbers[rule.id, rule.variant])
        number = numbers.setdefault((rule.id, rule.variant), len(numbers))
        keys = relations[rule.relation].identity
        if rule.distinct and (rule.distinct not in keys or rule.id in excess or "who" in _grain(plan.frame(rule.relation), keys)):
            keys = (rule.distinct,)
        own = None if rule.id in excess else plan.meetings(rule.relation, rule.predicate)
        if own is None:
            frames[rule.relation, rule.relation, keys].append(rule)
        else:
            frames[rule.relation, rule.relation + FEW, keys].append(rule)
            counted[rule.relation][f"r{place}"] = rule
            split.add(number)
    whole, parts = [], []
    for (_, name, keys), own in frames.items():
        passes: list[dict[int, Rule]] = [{}]
        for rule in own:
            number = numbers[rule.id, rule.variant]
            if number in passes[-1] or len(passes[-1]) == RULES_PER_PASS:
                passes.append({})
            passes[-1][number] = rule
        for some in passes:
            found = _offenders(plan.frame(name), some, keys, excess)
            if not split.intersection(some):
                whole.append(found)
            else:
                parts.append(found)
    for relation, tests in counted.items():
        identity = relations[relation].identity
        pairs = plan.counted(relation, {t: plan.meetings(relation, r.predicate) for t, r in tests.items()}, identity)
        names = ", ".join(f"{literal(t)}, {numbers[r.id, r.variant]}" for t, r in tests.items())
        parts.append(over({"pairs": pairs}, f"SELECT map({names})[test] AS rule, {_who(identity)} AS who, CAST(NULL AS DOUBLE) AS excess, "
                          "CAST(violations AS BIGINT) AS violations, FALSE AS once FROM {pairs}"))
    if not whole and not parts:
        return tables.spark.createDataFrame(
            [], "rule_id string, variant string, place long, who string, excess double, violations long")
    if parts:
        whole.append(over({"found": reduce(DataFrame.unionByName, parts)}, _MERGED).filter("violations > 0"))
    names = ", ".join(f"struct({literal(i)} AS rule_id, {literal(v)} AS variant)" for i, v in numbers)
    text = _RANKED.replace("{limit}", str(int(limit))).replace("{names}", names)
    if apart:  # a rule is in one of them
        ranked = reduce(DataFrame.unionByName, [kept(over({"found": found}, text)) for found in whole])
    else:
        ranked = over({"found": reduce(DataFrame.unionByName, whole)}, text)
    if results is None:
        return ranked
    failing = results.filter(F.col("status") == FAIL).select("rule_id", "variant")
    return ranked.join(failing, ["rule_id", "variant"], "left_semi")
