"""Every query of the trial-response operators, and its DuckDB SQL."""

from __future__ import annotations

from .plans import batch_queries, large_queries, raster_queries, record_queries, trace_queries
from .streaming import live_queries

FLAGSHIP = "holo_mean_ci"
_PARTS = (trace_queries, raster_queries, batch_queries, large_queries, record_queries, live_queries)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
