"""All queries of the engine's own operators, and the SQL that each must match."""

from __future__ import annotations

from tidemark.plans import q_flow, q_models, q_more, q_panel, q_stats, q_text  # noqa: F401  (they register their queries)
from tidemark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
