"""Measures of a table's own rules: observed while it is written, or kept by part and put together again.

A rule that looks at single rows of one table is judged from sums over its rows. Sums can be taken on the way to a
file, so that preparing, writing and judging are one job; and sums of parts (months) add up, so that a changed month is
measured alone and the whole table is judged without reading the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loanward.plans.evaluate import Plan, asked, evaluate, judged
from loanward.plans.rule import Rule
from loanward.sources.tables import Tables

#: The part of rows without a date.
UNDATED = "undated"
STATE = "part string, measure string, value long"


def row_rules(rules: Iterable[Rule], table: str) -> list[Rule]:
    """The rules that sum over single rows of the table alone."""
    def own(rule: Rule) -> bool:
        read = [rule.relation, *([rule.base.relation] if rule.base else []),
                *([relation for relation, _ in rule.count.parts.values()] if rule.count else [])]
        return rule.distinct is None and set(read) == {table}
    return [rule for rule in rules if own(rule)]


@dataclass(frozen=True)
class Measures:
    """What the rules of a table sum up; ``skipped`` are rules whose columns it lacks."""

    table: str
    amounts: dict[str, str]
    facts: list[str]
    skipped: list[Rule]
    tables: Tables

    @classmethod
    def of(cls, rules: Iterable[Rule], tables: Tables, table: str) -> Measures:
        rules = [r.at(tables.as_of) for r in rules]
        strangers = [r.id for r in rules if r not in row_rules(rules, table)]
        if strangers:
            raise ValueError(f"rules that need more than the rows of {table}: {', '.join(strangers)}")
        plan = Plan(tables)
        ready = [r for r in rules if plan.skip_reason(r) is None]
        unresolved = plan.unresolved(ready)
        ready = [r for place, r in enumerate(ready) if place not in unresolved]
        wanted, names, facts = asked(plan, ready)
        amounts = {names[full]: column for full, column in wanted.get(table, {}).items()}
        return cls(table, amounts, facts, [r for r in rules if r not in ready], tables)

    def sums(self) -> list[Column]:
        return [F.coalesce(F.sum(F.expr(amount)), F.lit(0)).cast("long").alias(name) for name, amount in self.amounts.items()]

    def results(self, values: DataFrame) -> DataFrame:
        """Result rows, as ``evaluate`` gives them, from (measure, value)."""
        skipped = evaluate(self.skipped, self.tables)
        return judged(values, self.facts).unionByName(skipped) if self.facts else skipped


def _words(df: DataFrame) -> DataFrame:
    return df if "_n" in df.columns else df.withColumn("_n", F.lit(1).cast("long"))


def write_judged(df: DataFrame, directory: str, name: str, rules: Iterable[Rule], tables: Tables,
                 partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``{directory}/{name}.parquet`` and give the result rows of its row rules, in one job.

    The sums are observed behind any exchange that the layout needs, in the tasks that write, so that a task counts
    once however often it is repeated. Other tables are not read.
    """
    measures = Measures.of(rules, tables.replace(**{name: df}), name)
    keys = list(partition_by)
    rows = _words(df)
    rows = rows.hint("rebalance", *[F.col(k) for k in keys]) if keys else rows
    seen = Observation()
    if measures.amounts:
        rows = rows.observe(seen, *measures.sums())
    path = f"{directory.rstrip('/')}/{name}.parquet"
    rows.select(df.columns).write.mode("overwrite").partitionBy(*keys).parquet(path)
    values = seen.get if measures.amounts else {}
    return measures.results(df.sparkSession.createDataFrame(
        [(m, int(values.get(m) or 0)) for m in measures.amounts], "measure string, value long"))


def measure_parts(rules: Sequence[Rule], tables: Tables, table: str, date: str, parts: Sequence[str] | None = None) -> DataFrame:
    """part, measure, value: sums by month of ``date``, the measure being the text of what is summed.

    With ``parts`` (like ``2023-04`` or ``undated``) only rows of these months are read, and one that has lost all its
    rows gets zeros, so that it replaces what was known of it.
    """
    measures = Measures.of(rules, tables, table)
    month = F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(UNDATED))
    rows = _words(tables[table])
    if parts is not None:
        rows = rows.filter(_in_parts(date, parts))
    sums = rows.groupBy(month.alias("part")).agg(*measures.sums())
    if parts is not None:
        sums = tables.spark.createDataFrame([(p,) for p in dict.fromkeys(parts)], "part string").join(sums, "part", "left")
    names = {amount: name for name, amount in measures.amounts.items()}  # two rules may sum the same
    pairs = [F.struct(F.lit(amount).alias("measure"), F.coalesce(name, F.lit(0)).alias("value"))
             for amount, name in names.items()]
    return sums.select("part", F.inline(F.array(*pairs)))


def _in_parts(date: str, parts: Sequence[str]) -> Column:
    """Ranges of the date itself, so that files and row groups of other months are left out."""
    out = F.lit(False)
    for p in parts:
        start = F.lit(f"{p}-01").cast("date")
        out = out | (F.col(date).isNull() if p == UNDATED else (F.col(date) >= start) & (F.col(date) < F.add_months(start, 1)))
    return out


def save_parts(state: DataFrame, path: str) -> None:
    """Write a state; parts that it holds replace those of the same name, others stay."""
    state.select("measure", "value", "part").coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def judge_parts(rules: Sequence[Rule], tables: Tables, table: str, path: str) -> DataFrame:
    """Result rows of the whole table from its saved parts; of ``tables`` only the schema is read."""
    measures = Measures.of(rules, tables, table)
    spark = tables.spark
    merged = spark.read.schema(STATE).parquet(path).groupBy("measure").agg(F.sum("value").alias("value"))
    known = spark.createDataFrame(list(measures.amounts.items()), "name string, measure string")
    # A measure that no part holds was not asked for when the state was made: its value is unknown, not zero.
    values = known.join(merged, "measure", "left").select(
        F.col("name").alias("measure"), F.when(F.col("value").isNotNull(), F.col("value")).otherwise(
            F.raise_error(F.concat(F.lit("not in the state: "), "measure"))).alias("value"))
    return measures.results(values)
