"""Named queries and the SQL that states the same result.

`query(name, sql)` registers a function of `Views`. Check SQL is assembled from the
named views in `VIEW_SQL`: a view is included when its name occurs in the text.
"""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
VIEW_SQL: dict[str, str] = {}
_NAME = re.compile(r"\bv_[a-z0-9_]+\b")


def view(name: str, sql: str) -> None:
    VIEW_SQL[name] = sql.strip()


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def assemble(sql: str) -> str:
    """Put the views a statement uses in front of it, dependencies first."""
    order: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in order or name in path:
                continue
            visit(VIEW_SQL[name], path + (name,))
            order.append(name)

    visit(sql, ())
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEW_SQL[n]})" for n in order) + "\n" + sql
