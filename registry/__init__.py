"""Registered queries and the SQL that must give the same rows."""

from registry import grid, learn, score, serve

ALL_QUERIES: dict = {}
ALL_SQL: dict[str, str] = {}
for _module in (grid, learn, score, serve):
    ALL_QUERIES.update(_module.QUERIES)
    ALL_SQL.update(_module.SQL)
