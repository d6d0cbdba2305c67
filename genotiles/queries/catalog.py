"""All registered queries."""

from __future__ import annotations

from genotiles.queries import (
    io_queries,
    metric_queries,
    score_queries,
    signal_queries,
    stream_queries,
    track_queries,
    window_queries,
)
from genotiles.queries.base import Query

_MODULES = (signal_queries, track_queries, metric_queries, score_queries, window_queries, io_queries, stream_queries)

CATALOG: dict[str, Query] = {query.name: query for module in _MODULES for query in module.QUERIES}
