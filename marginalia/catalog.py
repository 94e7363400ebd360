"""All queries of the library by name, with equivalent SQL for those that SQL can express."""

from __future__ import annotations

import importlib
import pkgutil

from . import queries
from .queries.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(queries.__path__):
    importlib.import_module(f"{queries.__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
