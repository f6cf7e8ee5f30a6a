"""Every query of the engine's own operators, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import catalog, documents, orders, records

FLAGSHIP = "knowledge_document"
_ALL = documents.QUERIES | orders.QUERIES | catalog.QUERIES | records.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
