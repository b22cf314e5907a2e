"""Registered queries: each operator on the given tables, with its SQL twin where SQL can express it."""

from . import ingest, preparation, ranking, selection

MODULES = (ingest, preparation, ranking, selection)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
