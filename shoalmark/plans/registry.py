"""Named queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from ..sources import adapters as A

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
NEEDS = {"items": ["products"], "lastday": ["tx"]}


def oracle(views: str, body: str) -> str:
    """``body`` is `ctes ... select`, with the views it names put before it."""
    names: list[str] = []
    for v in views.split():
        names += [x for x in [*NEEDS.get(v, []), v] if x not in names]
    ctes = [A.SQL[v] for v in names]
    body = body.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join([*ctes, body[5:]])
    return ("with " + ", ".join(ctes) + " " if ctes else "") + body


def query(name: str, views: str = "", sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(views, sql)
        return f

    return add
