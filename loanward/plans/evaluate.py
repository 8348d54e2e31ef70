"""Evaluate rules: one aggregate per relation instead of one job per rule."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.functions.sqltext import literal, over
from loanward.operators.pairs import Meeting, match_counts
from loanward.operators.skew import is_hot
from loanward.plans.meetings import ALL, MEETINGS, SIDES
from loanward.plans.relations import RELATIONS
from loanward.plans.rule import SKIP, Relation, Rule, columns_read, missing_input
from loanward.sources.tables import Tables

#: What is appended to a relation's name for its pairs under keys that at most one side repeats often, and for the
#: counts of the other pairs, which are not made.
FEW, CROWDED = "|few", "|crowded"

#: Columns of one aggregate; wider ones leave whole-stage code generation.
AGGREGATES_PER_PASS = 90

def _words(relation: Relation, tables: Tables) -> DataFrame:
    df = relation.build(tables)
    return df if "_n" in df.columns else df.withColumn("_n", F.lit(1).cast("long"))


class Plan:
    """Relations built once for the rules that share them."""

    def __init__(self, tables: Tables, relations=RELATIONS):
        self.tables = tables
        self.relations = relations
        self._frames: dict[str, DataFrame] = {}
        self._meetings: dict[str, dict[str, tuple[Meeting, ...]]] = defaultdict(dict)

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            plain = name.removesuffix(FEW).removesuffix(CROWDED)
            if name.endswith(FEW):
                sides = SIDES[plain]
                built = _words(self.relations[plain], self.tables.without(sides.left, sides.key, self.crowded(plain)))
            elif name.endswith(CROWDED):
                built = self.counted(plain, self._meetings[plain])
            else:
                built = _words(self.relations[plain], self.tables)
            self._frames[name] = built
        return self._frames[name]

    def crowded(self, relation: str) -> list:
        """Keys that both sides of a relation repeat often; none for relations that are no two-sided joins."""
        sides = SIDES.get(relation) if self.relations.get(relation) is RELATIONS.get(relation) else None
        return self.tables.crowded(sides.left, sides.right, sides.key) if sides else []

    def meetings(self, relation: str, predicate: str) -> tuple[Meeting, ...] | None:
        """How a predicate is counted under crowded keys; None where there are none, or pairs are all there is."""
        own = ALL if predicate == "TRUE" and relation in SIDES else MEETINGS.get((relation, predicate))
        return own if own and self.crowded(relation) else None

    def test(self, relation: str, predicate: str, own: tuple[Meeting, ...]) -> str:
        """The predicate's name in the relation's counts."""
        known = self._meetings[relation]
        for name, meetings in known.items():
            if meetings == own:
                return name
        name = f"t{len(known)}"
        known[name] = own
        return name

    def counted(self, relation: str, tests: dict[str, tuple[Meeting, ...]], identity: tuple[str, ...] = ()) -> DataFrame:
        """Pairs under crowded keys that meet the tests, counted."""
        sides, keys = SIDES[relation], self.crowded(relation)
        held = is_hot(F.col(sides.key), keys)
        left, right = sides.rows(self.tables[sides.left].filter(held)), self.tables[sides.right].filter(held)
        return match_counts(left, right, sides.key, tests, identity)

    def skip_reason(self, rule: Rule) -> str | None:
        """Why a rule cannot run.  Reads schemas only; a missing column never passes."""
        names = [rule.relation] + ([rule.base.relation] if rule.base else [])
        for name in names:
            reason = missing_input(self.relations[name].needs, self.tables)
            if reason:
                return reason
        for read in rule.reads:
            table, column = read.split(".")
            if column not in self.tables.columns(table):
                return f"column {read} not found"
        present = set(self.frame(rule.relation).columns)
        absent = [c for c in columns_read(rule) if c not in present]
        return f"column {absent[0]} not found" if absent else None

    def unresolved(self, rules: list[Rule]) -> dict[int, str]:
        """Reasons, by place, of rules whose expressions name what their relation lacks.

        The analyser decides, once per relation; rule by rule only where it objects.
        """
        reasons: dict[int, str] = {}
        places: dict[str, list[int]] = defaultdict(list)
        for place, rule in enumerate(rules):
            places[rule.relation].append(place)
        for relation, own in places.items():
            texts = {p: [t for t in (rules[p].predicate, rules[p].weight, rules[p].distinct) if t] for p in own}
            if self._objection(relation, [t for p in own for t in texts[p]]):
                for p in own:
                    objection = self._objection(relation, texts[p])
                    if objection:
                        reasons[p] = objection
        return reasons

    def _objection(self, relation: str, expressions: list[str]) -> str | None:
        try:
            self.frame(relation).selectExpr(*expressions)
        except AnalysisException as error:
            if not (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                raise
            return f"column {error.getMessageParameters()['objectName'].strip('`')} not found"
        return None


def _amount(rule: Rule) -> str:
    """What a violating row adds to the count."""
    weight = f"CAST({rule.weight} AS BIGINT) * _n" if rule.weight else "_n"
    return f"CASE WHEN {rule.predicate} THEN {weight} END"


def _sums(frame: DataFrame, measures: dict[str, str], grain: str | None) -> DataFrame:
    """Rows (measure, value): the sum of every measure over the frame.

    With a ``grain``, measures named ``d...`` count keys: the first level keeps one row per
    key (same partitioning as the window or join below it), the second adds up.
    """
    if grain is None:
        sums = ", ".join(f"coalesce(sum({c}), 0) AS {n}" for n, c in measures.items())
        inner = f"SELECT {sums} FROM {{frame}}"
    else:
        firsts = ", ".join(
            f"max(CASE WHEN {c} IS NOT NULL THEN 1L END) AS {n}" if n.startswith("d") else f"sum({c}) AS {n}"
            for n, c in measures.items())
        sums = ", ".join(f"coalesce(sum({n}), 0) AS {n}" for n in measures)
        inner = f"SELECT {sums} FROM (SELECT {firsts} FROM {{frame}} GROUP BY {grain})"
    pairs = ", ".join(f"struct('{n}' AS measure, CAST({n} AS BIGINT) AS value)" for n in measures)
    return over({"frame": frame}, f"SELECT inline(array({pairs})) FROM ({inner})")


#: Status, violations and details from the matching rows, the base and the tolerance mode.
_JUDGE = """
SELECT rule_id, title,
  CASE WHEN mode = 'info' THEN 'INFO'
       WHEN mode = 'band' AND base = 0 THEN 'SKIP'
       WHEN mode = 'band' THEN IF(pct BETWEEN low AND high, 'PASS', 'WARN')
       WHEN mode = 'strict_lt' THEN IF(matching < allowed, 'PASS', 'FAIL')
       WHEN matching <= allowed THEN 'PASS' ELSE 'FAIL' END AS status,
  CAST(CASE WHEN mode = 'info' THEN 0
       WHEN mode = 'band' AND base = 0 THEN -1
       WHEN mode = 'band' THEN IF(pct BETWEEN low AND high, 0, 1)
       ELSE matching END AS BIGINT) AS violations,
  allowed AS tolerance,
  CASE WHEN mode = 'info' THEN format_string('%d of %d rows', matching, base)
       WHEN mode = 'band' AND base = 0 THEN 'no rows to rate'
       WHEN mode = 'band' THEN format_string('%.2f%% (expect %.0f-%.0f%%)', pct, low, high)
       ELSE format_string('%d violations', matching) END AS details,
  severity, category, variant, matching, base
FROM (SELECT *, try_divide(matching * 100D, base) AS pct,
        CASE mode WHEN 'limit' THEN CAST(limit_ AS DOUBLE)
                  WHEN 'floor_le' THEN CAST(floor(greatest(minimum, share * base)) AS DOUBLE)
                  WHEN 'strict_lt' THEN share * base END AS allowed
      FROM (SELECT inline(array({facts})) FROM
             (SELECT map_from_entries(collect_list(struct(measure, value))) AS m FROM {values})))
"""


def asked(plan: Plan, rules: list[Rule]) -> tuple[dict[str, dict[tuple, str]], dict[tuple, str], list[str]]:
    """What the rules sum up: amounts by relation and measure, the measures' names, and the facts behind each judgement.

    Measures are asked for once per relation, whatever number of rules use them.
    """
    wanted: dict[str, dict[tuple, str]] = defaultdict(dict)
    names: dict[tuple, str] = {}
    facts = []

    def ask(relation: str, key: tuple, column: str, distinct: str | None) -> str:
        full = (relation, *key, distinct)
        if full not in names:
            names[full] = f"{'d' if distinct else 'm'}{len(names)}"
            wanted[relation][full] = column
        return names[full]

    def number(relation: str, predicate: str, key: tuple, column: str, distinct: str | None) -> str:
        """The measure; under keys that both sides of the relation repeat, pairs are counted and not made."""
        own = plan.meetings(relation, predicate)
        if own is None:
            return f"m['{ask(relation, key, column, distinct)}']"
        test = plan.test(relation, predicate, own)
        counted = ask(relation + CROWDED, ("test", test), f"CASE WHEN test = '{test}' THEN violations END", None)
        return f"(m['{ask(relation + FEW, key, column, distinct)}'] + m['{counted}'])"

    for r in rules:
        if r.count:
            matching = r.count.total
            for part, (relation, amount) in r.count.parts.items():
                matching = matching.replace(f"{{{part}}}", f"m['{ask(relation, ('part', amount), amount, None)}']")
        else:
            matching = number(r.relation, r.predicate, (r.predicate, r.weight), _amount(r), r.distinct)
        tol = r.tolerance
        base = "CAST(NULL AS BIGINT)"
        if tol.mode != "limit":
            rel, where = (r.base.relation, r.base.where) if r.base else (r.relation, "TRUE")
            base = number(rel, where, ("base", where), f"CASE WHEN {where} THEN _n END", None)
        values = {"rule_id": r.id, "variant": r.variant, "title": r.title, "severity": r.severity,
                  "category": r.category, "mode": tol.mode, "limit_": tol.limit, "share": float(tol.share),
                  "minimum": float(tol.minimum), "low": float(tol.low), "high": float(tol.high)}
        fields = ", ".join(f"{literal(x)} AS {n}" for n, x in values.items())
        facts.append(f"struct({fields}, CAST({matching} AS BIGINT) AS matching, {base} AS base)")
    return wanted, names, facts


def judged(values: DataFrame, facts: list[str]) -> DataFrame:
    """Result rows from the measures' values (measure, value)."""
    return over({"values": values}, _JUDGE.replace("{facts}", ", ".join(facts)))


#: Whether a finished job's shuffle files are deleted; read when a frame is made.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(small: DataFrame) -> DataFrame:
    """Rows that fit the driver, made by a job of their own whose shuffle files go with its end.

    Files of a larger plan stay until all of it has ended; parts that are kept one by one need the disk of one.
    """
    conf = small.sparkSession.conf
    before = conf.get(CLEAN_SHUFFLES, None)
    conf.set(CLEAN_SHUFFLES, "true")
    try:
        rows = small.select("*").collect()
    finally:
        if before is None:
            conf.unset(CLEAN_SHUFFLES)
        else:
            conf.set(CLEAN_SHUFFLES, before)
    return small.sparkSession.createDataFrame(rows, small.schema)


def _measured(plan: Plan, rules: list[Rule], apart: bool) -> DataFrame:
    """Judged result rows of the rules."""
    wanted, names, facts = asked(plan, rules)
    parts = []
    for relation, columns in wanted.items():
        grains = {full[-1] for full in columns if full[-1]}
        if len(grains) > 1:
            raise ValueError(f"relation {relation} has several distinct keys")
        items = [(names[full], c) for full, c in columns.items()]
        for start in range(0, len(items), AGGREGATES_PER_PASS):
            part = _sums(plan.frame(relation), dict(items[start:start + AGGREGATES_PER_PASS]), next(iter(grains), None))
            parts.append(kept(part) if apart else part)
    # One row per measure: the map below is as large as the list of rules.
    named = {f"part{i}": part for i, part in enumerate(parts)}
    values = over(named, " UNION ALL ".join(f"SELECT measure, value FROM {{{n}}}" for n in named))
    return judged(values, facts)


def evaluate(rules: Iterable[Rule], tables: Tables, relations=RELATIONS, apart: bool = False) -> DataFrame:
    """Result rows of the rules, in one plan: a scan, join or window pass per relation.

    A rule whose table or column is absent gives SKIP with the reason and -1 violations. With ``apart`` each relation
    is measured at once, by a job of its own: the disk holds what one relation shuffles, not what all do.
    """
    plan = Plan(tables, relations)
    ready, left_out = [], []
    for rule in (r.at(tables.as_of) for r in rules):
        reason = plan.skip_reason(rule)
        if reason:
            left_out.append((rule, reason))
        else:
            ready.append(rule)
    unresolved = plan.unresolved(ready)
    left_out += [(ready[place], reason) for place, reason in unresolved.items()]
    ready = [rule for place, rule in enumerate(ready) if place not in unresolved]
    skipped = [(r.id, r.title, SKIP, -1, None, reason, r.severity, r.category, r.variant, None, None)
               for r, reason in left_out]
    spark = tables.spark
    schema = ("rule_id string, title string, status string, violations long, tolerance double, details string, "
              "severity string, category string, variant string, matching long, base long")
    out = None
    if ready:
        out = _measured(plan, ready, apart)
    if skipped:
        rows = spark.createDataFrame(skipped, schema)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], schema)


def evaluate_one_by_one(rules: Iterable[Rule], tables: Tables, relations=RELATIONS) -> DataFrame:
    """The same results with a separate aggregate per rule: the check on the fusion."""
    return reduce(DataFrame.unionByName, [evaluate([r], tables, relations) for r in rules])


def violations(rule: Rule, tables: Tables, relations=RELATIONS) -> DataFrame:
    """The violating rows of a rule, for drill-down."""
    rule = rule.at(tables.as_of)
    plan = Plan(tables, relations)
    reason = plan.skip_reason(rule)
    if reason:
        raise ValueError(f"{rule.id}: {reason}")
    return plan.frame(rule.relation).filter(F.expr(rule.predicate))


def offenders(rule: Rule, tables: Tables, relations=RELATIONS) -> DataFrame:
    """Who violates a rule: identity columns and how often.

    Under keys that both sides of a join repeat, the pairs are counted and not made.
    """
    plan, identity = Plan(tables, relations), relations[rule.relation].identity
    reads = rule.at(tables.as_of)
    own = None if plan.skip_reason(reads) else plan.meetings(rule.relation, reads.predicate)
    if own:
        few = plan.frame(rule.relation + FEW).filter(F.expr(reads.predicate)).select(*identity, F.col("_n").alias("violations"))
        counted = plan.counted(rule.relation, {"rule": own}, identity).select(*identity, "violations")
        return few.unionByName(counted).groupBy(*identity).agg(F.sum("violations").alias("violations"))
    rows = violations(rule, tables, relations)
    if rule.distinct:
        return rows.select(rule.distinct).distinct().withColumn("violations", F.lit(1).cast("long"))
    amount = F.expr(rule.weight).cast("long") * F.col("_n") if rule.weight else F.col("_n")
    return rows.groupBy(*relations[rule.relation].identity).agg(F.sum(amount).alias("violations"))
