"""The corpus pipeline: toxicity, quality, near-duplicates, personal data, packing. Its stages are defined in graphloom.llm.pipeline."""

from __future__ import annotations

from graphloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
