"""The registered queries of the sequence operators and their SQL."""

from __future__ import annotations

from helixframe.plans import analysis_queries, record_queries
from helixframe.plans.record_queries import flagship  # noqa: F401

QUERIES = {**record_queries.QUERIES, **analysis_queries.QUERIES}
ORACLES = {**record_queries.ORACLES, **analysis_queries.ORACLES}
