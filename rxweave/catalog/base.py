"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(key: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a key, with its check SQL if any."""
    def register(fn):
        QUERIES[key] = fn
        if check is not None:
            CHECKS[key] = check
        return fn
    return register
