"""All queries of the library proper, by name, and their DuckDB equivalents."""

from __future__ import annotations


def queries() -> dict:
    from . import queries as q
    from . import role_queries  # noqa: F401

    return dict(q.QUERIES)


def oracle_sql() -> dict:
    from . import queries as q
    from . import role_queries  # noqa: F401

    return dict(q.ORACLES)
