"""Queries of the engine bound to the benchmark tables, each with its ANSI SQL counterpart."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """Import every catalog module once and return the filled registry."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
