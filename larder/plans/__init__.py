"""Named queries over the driver's tables."""

import importlib

from .registry import ORACLES, QUERIES

for _module in ("scalars", "catalogue", "linking", "recipes", "quotes", "baskets", "retail", "streams", "landing"):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
