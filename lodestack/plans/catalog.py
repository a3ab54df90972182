"""Every registered query of the retrieval engine with its SQL counterpart."""

from __future__ import annotations

from lodestack.plans import ingest_queries, lexical_queries, vector_queries  # noqa: F401  they register themselves
from lodestack.plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
