"""Registered queries: operators bound to the tables, each with its oracle."""

from __future__ import annotations

import importlib
import pkgutil
from types import SimpleNamespace


def all_plans() -> SimpleNamespace:
    """Load every plan module and return what they registered."""
    from cairnway.plans import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    oracles = {name: registry.with_views(sql) for name, sql in registry.ORACLES.items()}
    return SimpleNamespace(queries=registry.QUERIES, oracles=oracles)
