"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from evenkeel.plans.queries import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
