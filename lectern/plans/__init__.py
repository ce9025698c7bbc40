"""The queries of the core, with the SQL that each is compared with."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("archive", "evidence", "ledgers", "quality", "trials", "derivations")


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}
