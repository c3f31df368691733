"""Operators for training-data pipelines. Nothing outside this folder imports it, but for ``__spark_entry__``."""

from glossweave.llm.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
