"""All queries by name, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL if there is any."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


from . import queries_catalogue, queries_metrics, queries_sampling, queries_scores  # noqa: E402, F401
