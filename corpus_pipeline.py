"""The corpus pipeline: its stages, its SQL and the run over a folder of tables; see quillspark.llm.pipeline."""

from quillspark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
