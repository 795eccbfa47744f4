"""All registered queries and their SQL twins."""

from __future__ import annotations

from firmweave.plans import finance_queries, outreach_queries, page_queries, register_queries

_PARTS = (finance_queries, register_queries, outreach_queries, page_queries)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
