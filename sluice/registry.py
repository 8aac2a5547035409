"""All queries over the driver tables with their SQL counterparts."""

from __future__ import annotations

from .plans import dc_queries, monitor_queries, more_queries, stream_queries

QUERIES: dict = {**monitor_queries.Q, **dc_queries.Q, **stream_queries.Q, **more_queries.Q}
ORACLE_SQL: dict[str, str] = {**monitor_queries.SQL, **dc_queries.SQL, **stream_queries.SQL, **more_queries.SQL}
