"""Named queries of a plan module and the DuckDB SQL that must give the same rows."""

from __future__ import annotations


def registry():
    """(queries, SQL, decorator): ``@query(sql)`` files a function under its name."""
    queries: dict = {}
    oracle: dict = {}

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return register

    return queries, oracle, query
