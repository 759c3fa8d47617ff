"""All registered queries and their SQL twins."""

from __future__ import annotations

from caseflow.plans import answers, backfills, documents, files, flows, ranking, texts, trees, windows

MODULES = (ranking, windows, documents, answers, backfills, trees, texts, flows, files)


def queries():
    return {name: fn for module in MODULES for name, fn in module.registry.queries.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.registry.sql.items()}
