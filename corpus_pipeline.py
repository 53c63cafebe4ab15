"""Corpus preparation in stages, each a corpus operator over what the stage before it kept."""

from tidelog.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
