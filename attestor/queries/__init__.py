"""Registered queries of the library over the driver's tables, and their SQL twins."""

from . import agentic, evaluation, evidence, planning, records, retrieval, scoped, text, understanding

_PARTS = (text, retrieval, evidence, evaluation, understanding, planning, scoped, agentic, records)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
