"""The catalogue of queries over the engine's own operators, and their DuckDB SQL."""

from __future__ import annotations

from terrella.plans import builtin_queries, raster_queries, scalar_queries

QUERIES: dict = {**scalar_queries.QUERIES, **raster_queries.QUERIES, **builtin_queries.QUERIES}
ORACLE_SQL: dict = {**scalar_queries.ORACLE_SQL, **raster_queries.ORACLE_SQL, **builtin_queries.ORACLE_SQL}
