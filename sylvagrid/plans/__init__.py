"""The runnable queries: library operators applied to the derived layers."""

import importlib

from sylvagrid.plans.registry import checks, queries

__all__ = ["checks", "queries"]

for _name in ("stocks", "inventory", "scenes", "carbon", "climate", "space", "validation", "models", "allometry", "learning", "annual"):
    importlib.import_module(f"sylvagrid.plans.{_name}")
