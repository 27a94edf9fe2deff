"""Collects the registered queries of every plan module."""

from __future__ import annotations

from . import queries as _q


def _load() -> None:
    # importing the modules registers their queries
    from . import model_queries  # noqa: F401


def all_queries() -> dict:
    _load()
    return dict(_q.QUERIES)


def all_oracle_sql() -> dict:
    _load()
    return dict(_q.ORACLE)
