"""Importing this package registers every query."""

import importlib
import pkgutil

from lodestat.plans.registry import QUERIES, SQL

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name != "registry"):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["QUERIES", "SQL"]
