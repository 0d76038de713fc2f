"""Registered queries and their SQL oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (table reader) under its name; ``sql`` is the same result in DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def registered() -> tuple[dict, dict[str, str]]:
    from . import assembly, checks, evaluation, extras, files, ingest, pools, questions, relational, retrieval, streams  # noqa: F401
    from ..sources import table

    def bound(f):
        return lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))

    return {name: bound(f) for name, f in QUERIES.items()}, dict(ORACLES)
