"""The registered queries and their SQL, by name."""

from __future__ import annotations

from casegraph.plans import case_queries, graph_queries, model_queries, record_queries, search_queries, stream_queries, transfer_queries

_ALL = (transfer_queries, graph_queries, model_queries, record_queries, case_queries, stream_queries, search_queries)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _ALL for k, v in m.ORACLES.items()}
