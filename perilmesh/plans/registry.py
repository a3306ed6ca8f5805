"""All queries over the driver's tables, with their SQL for comparison."""

from __future__ import annotations

from . import assets, book, decide, extra, feeds, loss, more, spatial

_MODULES = (book, loss, decide, feeds, more, extra, assets, spatial)


def queries() -> dict:
    return {name: f for m in _MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
