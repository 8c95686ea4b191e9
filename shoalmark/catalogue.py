"""All registered queries of the retail part and their oracles."""

from __future__ import annotations

from .plans import registry


def _load() -> None:
    from .plans import assistant, features, misc, ml, rules  # noqa: F401


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
