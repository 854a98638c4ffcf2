"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from rankloom.plans import dataset_queries, model_queries  # noqa: F401  register
from rankloom.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
