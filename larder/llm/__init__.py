"""Training-data operators: one module an operator, each with its thin query, and the registry of queries."""

import importlib

from .registry import ORACLES, QUERIES

for _module in ("packing", "neighbours", "mixing", "exact", "urls", "quality", "simhash", "language", "sharding", "licences", "tokens", "tries", "alignment"):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
