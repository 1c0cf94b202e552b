"""The registry of queries and of their DuckDB equivalents."""

from __future__ import annotations

from barloom.sources import SQL

FLAGSHIP = "l03_multi_level_cross_daily"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, body: str | None = None, *tables: str):
    """Register a query; body is its SQL over driver tables and the named shared tables of barloom.sources.SQL."""

    def add(function):
        QUERIES[name] = function
        if body is not None:
            head = ",".join(SQL[t].strip() for t in tables)
            body_ = body.strip()
            if head and body_.upper().startswith("WITH "):
                recursive = body_.upper().startswith("WITH RECURSIVE ")
                ORACLE_SQL[name] = f"WITH {'RECURSIVE ' * recursive}{head}, {body_[15 if recursive else 5 :]}"
            else:
                ORACLE_SQL[name] = f"WITH {head}\n{body_}" if head else body_
        return function

    return add


from barloom.plans import documents, fundamentals, indicators, learning, market, relational, sequences, signals, streams  # noqa: E402, F401
