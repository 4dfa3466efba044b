"""All queries of the library by name, and the SQL that each is held against."""

from __future__ import annotations

MODULES: tuple[str, ...] = ("bars", "canonical", "evaluate", "features", "jobs", "panel", "signals")


def _all(attribute: str) -> dict:
    from importlib import import_module

    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"tidemark.plans.{name}"), attribute)
        if twice := found.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= part
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
