"""Registration of queries with their SQL, and composition of SQL from named views."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) by its name, with a DuckDB body that may use any of VIEWS."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = compose(sql)
        return f

    return add


def compose(body: str) -> str:
    """The body behind a WITH clause of the views that it uses, in order of need."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                need_name(name)

    def need_name(name: str) -> None:
        need(re.sub(rf"\b{name}\b", "", VIEWS[name]))
        if name not in order:
            order.append(name)

    need(body)
    clauses = ",\n".join(f"{name} AS (\n{VIEWS[name].strip()}\n)" for name in order)
    return f"WITH {clauses}\n{body.strip()}" if order else body.strip()
