"""All registered queries, importing every query module once."""

from __future__ import annotations

from . import q_analysis, q_analytics, q_inventory, q_models, q_reports, q_tables  # noqa: F401
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
