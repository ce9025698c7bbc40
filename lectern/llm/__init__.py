"""Operators for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

_MODULES: tuple[str, ...] = ("abuse", "encode", "garbled", "langid", "leaks", "lookalike", "near", "scans", "sentences")


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}
