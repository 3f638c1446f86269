"""Named queries over the given tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

import importlib

MODULES = ["scalar", "cleaning", "aggregates", "windows", "joins", "metrics", "decisions", "sources", "sinks", "models", "streams"]


def load() -> None:
    """Import every catalogue module so that its queries are registered."""
    for name in MODULES:
        importlib.import_module(f"skywharf.catalog.{name}")
