"""Registry of the engine's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from punchdeck.plans import analogues, easytrieve, edited, estate, fixtures, hosts, programs, sqlscripts, stated


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return analogues.QUERIES | fixtures.QUERIES | estate.QUERIES | programs.QUERIES | sqlscripts.QUERIES | edited.QUERIES | easytrieve.QUERIES | hosts.QUERIES


def oracle_sql() -> dict[str, str]:
    return analogues.SQL | estate.SQL | stated.SQL | programs.SQL | sqlscripts.SQL | edited.SQL | easytrieve.SQL | hosts.SQL
