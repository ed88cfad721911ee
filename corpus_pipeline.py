"""From raw documents to packed training sequences: the stages, and a run of them over a folder of tables."""

from loomtext.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
