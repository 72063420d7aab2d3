"""Registered queries: each runs one operator over the whole driver tables."""

import importlib
import pkgutil

from annalis.catalog.registry import ORACLES, QUERIES  # noqa: F401

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_module}")
