"""Incremental runs: which sources to read again and which rows go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Paths of ``now(path, content_hash)`` that are new or have other content."""
    return now.join(stored, ["path", "content_hash"], "left_anti").select("path")


def removed(now: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(now, "path", "left_anti").select("path")


def targets(changed_paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The changed sources and, one hop away, those that copy or include them and those that run them."""
    users = edges.filter(F.col("kind").isin("COPY", "INCLUDE", "EXECUTION")).join(changed_paths, F.col("to_path") == F.col("path"), "left_semi")
    return changed_paths.union(users.select(F.col("from_path").alias("path"))).distinct()


def without(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """Cascade: a fact table without the rows of sources that are gone."""
    return facts.join(gone, "path", "left_anti")


def normal_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""))


def in_scope(paths: DataFrame, scopes: list[str]) -> DataFrame:
    """Paths equal to a scope or below it, without regard to case and separators; no scope means all."""
    if not scopes:
        return paths
    p = normal_path(F.col("path"))
    hit = F.lit(False)
    for s in scopes:
        s = normal_path(F.lit(s))
        hit = hit | (p == s) | F.startswith(p, F.concat(s, F.lit("/")))
    return paths.filter(hit)
