"""All registered queries and their SQL."""

from __future__ import annotations

from . import base_queries, eval_queries, run_queries, tables_queries  # noqa: F401  (they register)
from .bindings import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
