"""All queries by name, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import evaluation_queries, graph_queries, order_queries, proof_queries, report_queries, smell_queries, source_queries, statement_queries, structure_queries

MODULES = (graph_queries, evaluation_queries, structure_queries, source_queries, smell_queries, statement_queries, order_queries, report_queries, proof_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
