"""Registered queries: name -> (function of a session and a folder, its SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ["spatial", "rasters", "catalogs", "texts", "layers", "jobs"]


def all_queries() -> dict:
    return {k: v for name in MODULES for k, v in import_module(f"{__name__}.{name}").QUERIES.items()}
