"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

import importlib

_MODULES = ("problems", "protocols", "quantify", "reporting", "windows", "learned")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= getattr(importlib.import_module(f"bagmeter.plans.{name}"), what)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
