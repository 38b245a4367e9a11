"""Named queries, one module per family of operators."""

from __future__ import annotations

import importlib

from scatterlake.plans import registry

MODULES: tuple[str, ...] = ("grid", "pattern", "integrate", "derive", "ingest", "iterate", "arrays", "recon", "maps", "waves")


def queries():
    """All registered queries by name."""
    for name in MODULES:
        importlib.import_module(f"scatterlake.plans.{name}")
    return registry.QUERIES


def oracle_sql():
    """Oracle SQL of the registered queries that have one."""
    queries()
    return registry.ORACLE
