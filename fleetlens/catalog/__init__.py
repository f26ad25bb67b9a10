"""Queries over the test tables, each with the SQL that states the same result."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """All registered queries and their SQL."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    from fleetlens.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
