"""All registered queries of the library."""

from __future__ import annotations

from . import documents, evidence, files, processes, relational, rules, texts
from .base import Query


MODULES = (relational, documents, evidence, rules, files, processes, texts)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, query in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.sql.items()}
