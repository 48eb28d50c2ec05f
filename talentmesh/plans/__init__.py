"""Named queries over the warehouse tables."""

from __future__ import annotations

import importlib

MODULES = ("matching_queries", "clean_queries", "cv_queries", "page_queries", "source_queries", "review_queries", "inventory_queries", "stream_queries", "sink_queries")


def load_all() -> None:
    """Import every query module, which fills the registry."""
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
