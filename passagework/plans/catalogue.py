"""The registered queries and the SQL that must return the same rows."""

from __future__ import annotations

from passagework.plans import answers, measures, pages, records, retrieval, rules

MODULES = [retrieval, rules, answers, measures, pages, records]


def queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
