"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import document_queries, join_queries, operator_queries, ordered_queries, rule_queries, text_queries, time_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
