"""The corpus pipeline, counted as part of ``tidewater.llm``, where its stages are."""

from tidewater.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
