"""Rule packs."""

from loanward.plans.packs.catalogue import CATALOGUE, CATALOGUE_SPEC, CHECKS
from loanward.plans.packs.foundation import FOUNDATION, FOUNDATION_SPEC, REDUCED
from loanward.plans.packs.runner import RUNNER, RUNNER_SPEC
from loanward.plans.rule import Pack

ALL_PACKS = {p.name: p for p in (
    FOUNDATION, RUNNER, CATALOGUE, CHECKS, FOUNDATION_SPEC, RUNNER_SPEC, CATALOGUE_SPEC)}
NAMED = Pack("named", tuple(r for p in (FOUNDATION, RUNNER, CATALOGUE) for r in p))
