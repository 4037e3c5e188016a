"""Queries over the tables at hand, with SQL for each that SQL can express."""

from __future__ import annotations

from importlib import import_module

from .registry import Queries, Query

MODULES = ("graph", "states", "search", "build", "grading", "documents", "editing", "extraction", "streams", "store", "walks", "sources", "forests", "counting", "problems", "formulas", "styles")


def _every() -> list[Queries]:
    return [import_module(f"{__name__}.{name}").Q for name in MODULES]


def own_queries() -> dict[str, Query]:
    return {name: query for q in _every() for name, query in q.queries.items()}


def own_sql() -> dict[str, str]:
    return {name: sql for q in _every() for name, sql in q.sql.items()}
