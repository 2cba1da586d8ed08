"""Every query of the engine's own operators."""

from __future__ import annotations

from marlstone.plans import dossier_queries, entity_queries, extract_queries, flow_queries, link_queries, market_queries, recommend_queries, research_queries, retrieval_queries, selection_queries, stream_queries, thesis_queries, upkeep_queries  # noqa: F401
from marlstone.plans.registry import ORACLES, QUERIES  # noqa: F401
