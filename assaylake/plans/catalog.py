"""All registered queries."""

import importlib

from assaylake.plans.registry import QUERIES

MODULES = ["analyses", "scoring", "quality", "tables", "maps", "calibrate", "fits", "comparisons"]

for _module in MODULES:
    importlib.import_module(f"assaylake.plans.{_module}")

__all__ = ["QUERIES"]
