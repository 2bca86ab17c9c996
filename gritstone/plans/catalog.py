"""Registry of the core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import coverage, graph, lookups, parsing, questions, scoring, shaping, state, store, texts

FAMILIES = (scoring, questions, state, texts, shaping, store, lookups, graph, coverage, parsing)


def ranked_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: answers to issues to severities, weights and the first page."""
    return scoring.ranked_issues(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
