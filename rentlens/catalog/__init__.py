"""Registered queries over the given tables, each with the SQL it is checked against."""

from __future__ import annotations

import importlib

AREAS = ["files", "cleaning", "tables", "keys", "models", "reports", "dormant"]


def load():
    """Import every area, which registers its queries, and return the registry."""
    for area in AREAS:
        importlib.import_module(f"rentlens.catalog.{area}")
    return importlib.import_module("rentlens.catalog.registry")
