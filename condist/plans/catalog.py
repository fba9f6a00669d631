"""The registered queries, by name, and their SQL."""

from __future__ import annotations

from condist.plans import alerts, core, live, operations, store, versions  # noqa: F401  (register their queries)
from condist.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
