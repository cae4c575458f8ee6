"""The registry of this subpackage's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import queries_free, queries_native


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators' queries; the pipeline, which lies outside this package, is added where the driver enters."""
    return {**queries_native.QUERIES, **queries_free.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**queries_native.SQL, **queries_free.SQL}
