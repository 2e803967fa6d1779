"""Line operators: custom line rules, fixed-format areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_lines(sources: DataFrame, id_: str, text: str) -> DataFrame:
    """``(id, line, raw)``, lines from 1; a null text has none."""
    return sources.select(id_, F.posexplode(F.split(text, "\n", -1)).alias("at", "raw")).select(id_, (F.col("at") + 1).alias("line"), "raw")


def body(raw: Column) -> Column:
    """Columns 8 to 72."""
    return F.substring(raw, 8, 65)


def indicator(raw: Column) -> Column:
    return F.substring(raw, 7, 1)


def is_comment(raw: Column) -> Column:
    """A comment line or page break of fixed format."""
    return indicator(raw).isin("*", "/")


def line_rule(lines: DataFrame, rule_id: str, pattern: str, exclude: str | None = None, message: str = "${match}", program_area: bool = False) -> DataFrame:
    """One finding for each line that ``pattern`` hits and ``exclude`` doesn't, at the first hit.

    ``program_area``: columns 8 to 72 alone are searched and comment lines are passed over.
    """
    text = body(F.col("raw")) if program_area else F.col("raw")
    hit = text.rlike(pattern)
    if exclude:
        hit &= ~text.rlike(exclude)
    if program_area:
        hit &= ~is_comment(F.col("raw"))
    found = lines.filter(hit).withColumn("match", F.regexp_extract(text, pattern, 0)).withColumn("text_", text)
    column = F.expr("instr(text_, match)") + (7 if program_area else 0)
    return found.select(*[c for c in lines.columns if c != "raw"], F.lit(rule_id).alias("rule_id"), column.cast("int").alias("col"), F.replace(F.lit(message), F.lit("${match}"), F.col("match")).alias("message"))


def logical_lines(lines: DataFrame) -> DataFrame:
    """Lines without comments, as their program area."""
    return lines.filter(~is_comment(F.col("raw"))).withColumn("text", body(F.col("raw"))).drop("raw")


def statement_rule(statements: DataFrame, rule_id: str, verbs: list[str], clauses: list[str] | None = None, paragraph: str | None = None, message: str = "") -> DataFrame:
    """Statements of one of the verbs with none of the clauses, in paragraphs whose name matches.

    ``statements(file, line, verb, text, paragraph)``.
    """
    hit = F.upper("verb").isin(*(v.upper() for v in verbs))
    for c in clauses or ():
        hit &= ~F.upper("text").contains(c.upper())
    if paragraph:
        hit &= F.col("paragraph").rlike(paragraph)
    return statements.filter(hit).select(F.lit(rule_id).alias("rule_id"), "file", "line", F.lit(message).alias("message"))
