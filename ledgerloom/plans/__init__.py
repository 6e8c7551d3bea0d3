"""Registered queries by family."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every family once and return (queries, oracles)."""
    from . import registry

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLES
