"""Query modules of the core; each has QUERIES and SQL (the DuckDB oracle)."""

from importlib import import_module

MODULES = ("arena", "judging", "curation", "detection", "monitoring", "serving")


def _merged(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"palaver.plans.{name}"), what))
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
