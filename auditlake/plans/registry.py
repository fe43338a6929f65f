"""Name -> query function and name -> DuckDB SQL, for everything outside ``llm``."""

from __future__ import annotations

from . import corpora, details, handlers, projections  # details adds its queries to those of projections

QUERIES = projections.QUERIES | corpora.QUERIES | handlers.QUERIES
ORACLE_SQL = projections.ORACLE_SQL | corpora.ORACLE_SQL | handlers.ORACLE_SQL
FLAGSHIP = "worst_verdict"
