"""Registered queries over the driver tables, with their check SQL."""

import importlib

MODULES = ("areas", "registry_queries", "shapes", "rasters", "series_queries", "network_queries", "ingest_queries")


def load() -> None:
    """Import every query module so its queries are registered."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
