"""Rules and the row sources they test, as plain records."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from loanward.sources.schemas import MODEL
from loanward.sources.tables import Tables

PASS, FAIL, WARN, SKIP, INFO = "PASS", "FAIL", "WARN", "SKIP", "INFO"


@dataclass(frozen=True)
class Relation:
    """A row source for rules: a table, a join, a window pass, an aggregate.

    ``identity`` names the columns that tell which rows are wrong; ``_n`` (optional in
    the frame) is the number of table rows a row stands for.
    """

    name: str
    needs: Mapping[str, tuple[str, ...]]
    build: Callable[[Tables], DataFrame]
    identity: tuple[str, ...]


@dataclass(frozen=True)
class Tolerance:
    """How many violations pass.

    ``limit``      violations <= limit
    ``floor_le``   violations <= floor(max(minimum, share * base))
    ``strict_lt``  violations <  share * base
    ``band``       low <= 100 * matching / base <= high, else WARN
    ``info``       no judgement
    """

    mode: str = "limit"
    limit: int = 0
    share: float = 0.0
    minimum: float = 0.0
    low: float = 0.0
    high: float = 0.0


ZERO = Tolerance()
INFORMATION = Tolerance("info")


def at_most(share: float, minimum: float = 0.0) -> Tolerance:
    return Tolerance("floor_le", share=share, minimum=minimum)


def below(share: float) -> Tolerance:
    return Tolerance("strict_lt", share=share)


def band(low: float, high: float) -> Tolerance:
    return Tolerance("band", low=low, high=high)


@dataclass(frozen=True)
class Base:
    """Denominator of a relative tolerance; default is the rule's own relation."""

    relation: str
    where: str = "TRUE"


@dataclass(frozen=True)
class Count:
    """A cheaper way to a rule's number than its violating rows.

    ``parts`` are sums over other relations (relation, SQL amount per row), ``total`` puts
    them together by name in braces.
    """

    parts: Mapping[str, tuple[str, str]]
    total: str = "{v}"


def summed(relation: str, amount: str) -> Count:
    return Count({"v": (relation, amount)})


@dataclass(frozen=True)
class Rule:
    """``predicate`` is a SQL expression that is true for a violating row.

    ``distinct`` counts keys instead of rows; ``weight`` replaces the row count by an
    expression.  ``columns`` lists the columns read when they cannot be recognised as
    names of the lending model, ``reads`` the table columns behind derived ones.  ``count``
    is used where only the number is wanted.
    """

    id: str
    title: str
    relation: str
    predicate: str
    kind: str
    tolerance: Tolerance = ZERO
    severity: str = "CRITICAL"
    category: str = ""
    variant: str = "code"
    distinct: str | None = None
    weight: str | None = None
    base: Base | None = None
    columns: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()
    count: Count | None = None

    def at(self, as_of) -> Rule:
        """The rule with ``{as_of}`` replaced by a typed date literal."""
        text = f"DATE '{as_of.isoformat()}'"
        base = self.base and replace(self.base, where=self.base.where.replace("{as_of}", text))
        count = self.count and replace(self.count, parts={
            name: (relation, amount.replace("{as_of}", text))
            for name, (relation, amount) in self.count.parts.items()})
        return replace(self, predicate=self.predicate.replace("{as_of}", text), base=base, count=count)


@dataclass(frozen=True)
class Pack:
    """A named list of rules."""

    name: str
    rules: tuple[Rule, ...] = field(default=())

    def __iter__(self):
        return iter(self.rules)

    def __len__(self) -> int:
        return len(self.rules)

    def rule(self, rule_id: str) -> Rule:
        return next(r for r in self.rules if r.id == rule_id)

    def select(self, ids) -> Pack:
        wanted = set(ids)
        return Pack(self.name, tuple(r for r in self.rules if r.id in wanted))


#: Column names of the lending model: words in a predicate that must exist to be read.
MODEL_COLUMNS = frozenset(c for columns in MODEL.values() for c in columns)
_LITERAL = re.compile(r"'[^']*'")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def columns_read(rule: Rule, prefixes: tuple[str, ...] = ("app_", "rep_", "prev_", "opened_")) -> list[str]:
    """Columns of the lending model that a rule's expressions mention."""
    text = " ".join(_LITERAL.sub(" ", t) for t in (rule.predicate, rule.weight or "", rule.distinct or ""))
    found = dict.fromkeys(rule.columns)
    for word in _WORD.findall(text):
        bare = next((word[len(p):] for p in prefixes if word.startswith(p)), word)
        if word in MODEL_COLUMNS or bare in MODEL_COLUMNS:
            found[word] = None
    return list(found)


def missing_input(needs: Mapping[str, tuple[str, ...]], tables: Tables) -> str | None:
    """Why a relation cannot be built, or None.  Looks at schemas only."""
    for table, columns in needs.items():
        if table not in tables:
            return f"table {table} not found"
        absent = [c for c in columns if c not in tables.columns(table)]
        if absent:
            return f"column {table}.{absent[0]} not found"
    return None
