"""Registered queries with their oracle SQL."""

from __future__ import annotations

from sparkveil.catalog.registry import ORACLES, QUERIES  # noqa: F401


def load() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
