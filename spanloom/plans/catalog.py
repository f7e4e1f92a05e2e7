"""Registry of the library's queries, each with the DuckDB text that yields the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans import annotations, archives, contracts, graph, journal, ledgers, pooling, records, replay, scoring, statistics, text, vectors, verdicts
from spanloom.streaming import events, fates

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of queries; each has QUERIES (name to callable) and ORACLES (name to SQL).
MODULES = (scoring, text, annotations, statistics, graph, journal, verdicts, ledgers, records, replay, contracts, vectors, pooling, archives, events, fates)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
