"""Independent SQL for the named queries, run by DuckDB on the same tables."""

from __future__ import annotations

import importlib
import warnings

MODULES = ("sales", "features", "texts", "streams", "storage")


def oracle_sql() -> dict[str, str]:
    """All oracles. A module that cannot be imported costs its own oracles only, with a warning."""
    found: dict[str, str] = {}
    for name in MODULES:
        try:
            found.update(importlib.import_module(f"oracles.{name}").Q)
        except Exception as error:
            warnings.warn(f"no oracles from oracles.{name}: {error!r}", stacklevel=2)
    return found
