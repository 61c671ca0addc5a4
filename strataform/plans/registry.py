"""All queries of the core and their SQL counterparts, by name."""

from __future__ import annotations

from strataform.plans import reference, reference_sql, reports, reports_sql, store, store_sql, trees, trees_sql


def numbered(module) -> dict:
    """The queries of a module, named after the problem they answer."""
    return {k: f for k, f in vars(module).items() if k[0] == "p" and k[1].isdigit() and callable(f)}


_STORE = numbered(store)

QUERIES = _STORE | reference.QUERIES | trees.QUERIES | reports.QUERIES
SQL = {k: getattr(store_sql, k.upper()) for k in _STORE if hasattr(store_sql, k.upper())} | reference_sql.SQL | trees_sql.SQL | reports_sql.SQL
