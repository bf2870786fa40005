"""Registered queries and the SQL that says what each returns."""

from __future__ import annotations

from importlib import import_module

MODULES = ("plans.corpus", "plans.dedup", "plans.relational", "plans.evaluation", "plans.ordering", "plans.reshaping", "plans.audits", "plans.streams")


class Register(dict):
    """Collects a module's queries: used as a decorator with the query's SQL, or None where SQL can't say it."""

    def __init__(self) -> None:
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def _modules() -> list:
    return [import_module(f"loamworks.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.QUERIES.oracles.items()}
