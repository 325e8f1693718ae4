"""Queries over the given tables, one per operator."""

from __future__ import annotations

import importlib

MODULES = [
    "scalars",
    "relational",
    "temporal",
    "tags",
    "maps",
    "view_jobs",
    "changes",
    "checks",
]


def load():
    """All queries and their checking SQL."""
    for module in MODULES:
        importlib.import_module(f"terrachron.registry.{module}")
    from terrachron.registry.base import ORACLE, QUERIES

    return dict(QUERIES), dict(ORACLE)
