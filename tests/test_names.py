"""Every name that a function of the library reads from its module is there."""

import builtins
import dis
import importlib
import pkgutil
from types import CodeType, ModuleType

import pytest

import loanward
import oracle


def modules(package: ModuleType, without: str = ""):
    for found in pkgutil.walk_packages(package.__path__, f"{package.__name__}."):
        if not (without and found.name.startswith(without)):
            yield found.name


def unknown_names(module: ModuleType) -> set[str]:
    known = set(vars(module)) | set(vars(builtins))
    missing: set[str] = set()

    def walk(code: CodeType) -> None:
        missing.update(i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL" and i.argval not in known)
        for part in code.co_consts:
            if isinstance(part, CodeType):
                walk(part)

    with open(module.__file__, encoding="utf-8") as file:
        walk(compile(file.read(), module.__file__, "exec"))
    return missing


@pytest.mark.parametrize("name", [*modules(loanward, "loanward.llm"), *modules(oracle)])
def test_names_are_defined(name):
    assert unknown_names(importlib.import_module(name)) == set()
