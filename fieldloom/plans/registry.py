"""Where the query modules register their queries and SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, *sql: str):
    """Register a function of (spark, sf_dir); sql: fragments "name as (...)" and a last SELECT."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = ("with " + ",\n".join(sql[:-1]) + "\n" if len(sql) > 1 else "") + sql[-1]
        return f

    return put
