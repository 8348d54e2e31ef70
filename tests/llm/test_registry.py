"""Registered queries: their SQL, and names that a module lacks."""

import importlib

import pytest

import loanward.llm
from loanward.llm import registry
from tests.test_names import modules, unknown_names


def test_queries_without_sql_are_listed():
    assert set(registry.queries()) - set(registry.oracles()) == registry.WITHOUT_SQL
    assert set(registry.oracles()) <= set(registry.queries())


@pytest.mark.parametrize("name", list(modules(loanward.llm)))
def test_names_are_defined(name):
    assert unknown_names(importlib.import_module(name)) == set()
