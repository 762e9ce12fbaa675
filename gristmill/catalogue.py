"""All queries over the star schema and their SQL, gathered from ``plans``."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans
from .plans.registry import QUERIES, SQL

FLAGSHIP = "top_n_summary"

for _found in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"{plans.__name__}.{_found.name}")

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
