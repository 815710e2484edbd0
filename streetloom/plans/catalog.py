"""All queries of the engine outside the text-corpus subpackage, with their SQL twins."""

from __future__ import annotations

from streetloom.sources.fixtures import with_views

from . import display, files, geodata, network, routing

MODULES = (network, routing, geodata, display, files)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for m in MODULES for name, sql in m.SQL.items()}
