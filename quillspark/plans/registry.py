"""All queries on the test tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import bound, domain, grouped, joined, layered, matched, ordered, scalars, stateful

MODULES = (ordered, joined, grouped, scalars, matched, stateful, domain, bound, layered)


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
