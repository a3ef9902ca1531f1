"""The corpus pipeline: its stages, in order, and what runs them all (see recordgauge.llm.pipeline)."""

from recordgauge.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
