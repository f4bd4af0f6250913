"""All registered queries."""

from __future__ import annotations

from tidemark.plans import q_captures, q_layouts, q_scalars, q_sources, q_text, q_time  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
