"""Where the training-data queries register themselves, each with the SQL that checks it."""

from __future__ import annotations

QUERIES: dict = {}
CHECKS: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function
    return add
