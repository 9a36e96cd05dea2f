"""The training-data pipeline: its stages, its SQL and its run lie in tessel.llm.pipeline."""

from tessel.llm.pipeline import ORACLE_SQL, PERCENT, SHINGLE, STAGES, run

__all__ = ["ORACLE_SQL", "PERCENT", "SHINGLE", "STAGES", "run"]
