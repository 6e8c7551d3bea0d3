"""Operators for preparing training text, each in a module of its own."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every operator and return (queries, oracles) by query name."""
    found, sql = {}, {}
    for info in pkgutil.iter_modules(__path__):
        module = importlib.import_module(f"{__name__}.{info.name}")
        found |= getattr(module, "QUERIES", {})
        sql |= getattr(module, "ORACLES", {})
    return found, sql
