"""All queries outside the llm subpackage: name to callable, and name to DuckDB SQL."""

from __future__ import annotations

from . import media, parsing

_PARTS = (parsing, media)

QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL = {k: sql for part in _PARTS for k, sql in part.ORACLE_SQL.items()}
