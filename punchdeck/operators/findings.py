"""Findings ``(rule_id, level, file, line, message)`` and the catalogue of rules: selection, filters, counts, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.functions import columns as C
from punchdeck.operators import incremental


def missing_scopes(paths: DataFrame, scopes: DataFrame) -> DataFrame:
    """``scopes(scope)`` that no path is equal to or below."""
    p, s = incremental.normal_path(F.col("path")), incremental.normal_path(F.col("scope"))
    above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))
    held = paths.select(F.split(p, "/").alias("parts")).select(F.explode(above).alias("s_")).distinct()
    return scopes.withColumn("s_", s).join(held, "s_", "left_anti").select("scope")


def narrowed(sources: DataFrame, scopes: list[str]) -> DataFrame:
    """The sources of a run with scopes: only COBOL sources outside of them are left out."""
    return sources.filter("kind <> 'COBOL'").unionByName(incremental.in_scope(sources.filter("kind = 'COBOL'"), scopes))


def in_scope(findings: DataFrame, files: DataFrame, members: DataFrame) -> DataFrame:
    """Findings in files of the scope or in members that those expand: ``files(file)``, ``members(file, member)``."""
    seen = files.select("file").union(members.join(files, "file", "left_semi").select("member")).distinct()
    return findings.join(seen, "file", "left_semi")


def catalogue(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """``rules(rule_id, enabled, severity, …)`` with the overrides' ``enabled`` and ``severity`` where they state them."""
    o = overrides.select("rule_id", F.col("enabled").alias("e_"), F.col("severity").alias("s_"))
    return rules.join(o, "rule_id", "left").withColumns({"enabled": F.coalesce("e_", "enabled"), "severity": F.coalesce("s_", "severity")}).drop("e_", "s_")


def for_command(rules: DataFrame, command: str) -> DataFrame:
    """Enabled rules that run under a command; FIX asks for a producer of fixes as well."""
    run = rules.filter(F.col("enabled") & F.array_contains("commands", command))
    return run.filter("has_fix") if command == "FIX" else run


def on_target(findings: DataFrame, sources: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings in SQL scripts and Easytrieve sources stay only if their rule targets that kind."""
    met = findings.join(sources.select(F.col("path").alias("file"), F.col("kind").alias("k_")), "file", "left").join(rules.select("rule_id", "targets"), "rule_id", "left")
    asked = F.coalesce(F.col("k_").isin("SQL_SCRIPT", "EASYTRIEVE"), F.lit(False))
    return met.filter(~asked | F.coalesce(F.array_contains("targets", F.col("k_")), F.lit(False))).select(*findings.columns)


def matching(rules: DataFrame, text: str) -> DataFrame:
    """Rules whose id, name or description holds the text."""
    return rules.filter(F.contains(F.lower(F.concat_ws(" ", "rule_id", "name", "description")), F.lit(text.strip().lower())))


def with_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the rule's ``name`` and ``severity``; for an unknown rule the finding's level stands for its severity."""
    met = findings.join(rules.select("rule_id", "name", F.col("severity").alias("s_")), "rule_id", "left")
    back = F.when(F.col("level") == "error", "HIGH").when(F.col("level") == "warning", "MEDIUM").otherwise("LOW")
    return met.withColumn("severity", F.coalesce("s_", back)).drop("s_")


def by_category(rules: DataFrame) -> DataFrame:
    return rules.groupBy("category").agg(F.array_sort(F.collect_list("rule_id")).alias("rules"))


def exit_code(findings: DataFrame) -> DataFrame:
    """One row ``(exit_code)``: 2 for errors, 1 for warnings, else 0."""
    return findings.agg(F.coalesce(F.max(C.exit_code(F.col("level"))), F.lit(0)).alias("exit_code"))


def numbered(findings: DataFrame, order: str) -> DataFrame:
    """Adds ``nth``: which finding of that rule on that line it is, from 0, and the ``identity`` that a view keys it by.
    It is counted before any filter, so a filter doesn't rename findings."""
    nth = F.row_number().over(Window.partitionBy("file", "line", "rule_id").orderBy(order)) - 1
    return findings.withColumn("nth", nth).withColumn("identity", F.concat_ws("|", "file", "line", "rule_id", F.when(F.col("nth") > 0, F.col("nth"))))


RANK = {"HIGH": 3, "MEDIUM": 2, "ADVISORY": 1, "LOW": 0}


def rank(severity: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[severity]


def shown(findings: DataFrame, threshold: str, severities: list[str], text: str = "") -> DataFrame:
    """What a panel shows: at least as severe as the threshold, of the chosen severities, holding the text."""
    rows = findings.filter((rank(F.col("severity")) >= RANK[threshold]) & F.col("severity").isin(*severities))
    text = text.strip().lower()
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", "rule_id", "file", "message")), F.lit(text))) if text else rows


def hidden(findings: DataFrame, threshold: str) -> DataFrame:
    """One row ``(hidden)``: findings below the threshold."""
    return findings.agg(F.count_if(rank(F.col("severity")) < RANK[threshold]).alias("hidden"))


def by_rule(*more: str) -> list[Column]:
    """Order by rule: letters, then the number as a number."""
    return [F.regexp_extract("rule_id", "^([A-Za-z]+)", 1), F.regexp_extract("rule_id", r"(\d+)$", 1).try_cast("int"), *map(F.col, more)]


def per_file(findings: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """``(file, n)``; with ``rules`` of those alone, such as the three that tell of statements read in part."""
    rows = findings.filter(F.col("rule_id").isin(*rules)) if rules else findings
    return rows.groupBy("file").agg(F.count("*").alias("n"))


def merged(**parts: DataFrame) -> DataFrame:
    """All findings of several runs, each with its ``origin``."""
    out = None
    for origin, rows in parts.items():
        rows = rows.withColumn("origin", F.lit(origin))
        out = rows if out is None else out.unionByName(rows)
    return out


def reported_once(diagnostics: DataFrame, *identity: str) -> DataFrame:
    """Diagnostics of a member that several jobs expand, once each."""
    return diagnostics.select(*identity).distinct()
