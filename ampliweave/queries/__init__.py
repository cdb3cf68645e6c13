"""Registered queries of the read operators, with SQL for DuckDB where SQL can say it."""

from . import alignment, relational, scalars

MODULES = (scalars, relational, alignment)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.SQL.items()}
