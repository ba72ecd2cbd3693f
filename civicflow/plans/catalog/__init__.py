"""Query catalogue: every implemented operator applied to the driver tables.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` and, where the
operator is SQL-expressible, an independent ANSI/DuckDB oracle over the same
tables.  Column names are aliased identically on both sides.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

_REGISTRY: dict[str, tuple[Callable, str | None]] = {}

_FAMILIES = ["dates_clean", "enrich", "profile", "categories", "splits", "evaluation",
             "fairness", "scaling", "models", "scoring", "sources", "housekeeping"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load():
    for fam in _FAMILIES:
        importlib.import_module(f"{__name__}.{fam}")


def queries() -> dict[str, Callable]:
    _load()
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in _REGISTRY.items() if v[1]}
