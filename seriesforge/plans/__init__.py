"""Named queries over the test tables."""

from __future__ import annotations

import importlib

MODULES = ("relational", "windowed", "analytics", "more", "sqltext", "models")


def all_queries():
    """The queries and the SQL of those that have some."""
    from . import registry

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLE_SQL
