"""Registered queries over the driver tables, with their SQL counterparts."""

from __future__ import annotations

import importlib

from graticule.plans.registry import REGISTRY, Query

_MODULES = (
    "grid_queries", "catalog_queries", "place_queries", "request_queries", "lineage_queries", "stream_queries",
)


def load_queries() -> dict[str, Query]:
    """All registered queries by name."""
    for module in _MODULES:
        importlib.import_module(f"graticule.plans.{module}")
    return dict(REGISTRY)
