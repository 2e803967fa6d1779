"""Findings as SARIF 2.1.0 and back; graphs as DOT and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOOL = "punchdeck"
PLACE = "physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>"
RESULT = f"ruleId:string,level:string,message:struct<text:string>,locations:array<struct<{PLACE}>>"
SARIF = f"version string, runs array<struct<results:array<struct<{RESULT}>>>>"


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.replace("file", F.lit("\\"), F.lit("/")), "line", "rule_id", "message")


def results(findings: DataFrame) -> DataFrame:
    """A column ``json`` with a SARIF result for each finding."""
    place = F.struct(F.struct(F.struct(F.replace("file", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    row = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("file", "line", "rule_id", "message", F.to_json(row).alias("json"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """One log in one file of the folder ``path``: a report for readers, written by one task; findings that are too
    many for that are kept as a table."""
    rows = results(findings)
    n = F.row_number().over(Window.orderBy(F.replace("file", F.lit("\\"), F.lit("/")), "line", "rule_id", "message"))
    lines = rows.select(n.alias("n"), "json").select("n", F.concat(F.when(F.col("n") == 1, "").otherwise(","), "json").alias("value"))
    head = f'{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL}"}}}},"results":['
    spark = findings.sparkSession
    ends = spark.range(1).select(F.lit(0).alias("n"), F.lit(head).alias("value")).union(spark.range(1).select(F.lit((1 << 31) - 1), F.lit("]}]}")))
    lines.union(ends).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    run = spark.read.schema(SARIF).json(path, multiLine=True).select(F.explode("runs").alias("run"))
    rows = run.select(F.explode("run.results").alias("r")).select("r.*", F.get("r.locations", 0)["physicalLocation"].alias("p"))
    return rows.select(F.col("ruleId").alias("rule_id"), "level", F.col("p.artifactLocation.uri").alias("file"), F.col("p.region.startLine").alias("line"), F.col("message.text").alias("message"))


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT document, numbered for an ordered sink."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    n = nodes.select(F.lit(1).alias("part"), "id", F.concat(F.lit("  "), quote("id"), F.lit(" [label="), quote("label"), F.lit("];")).alias("line"))
    e = edges.select(F.lit(2), F.concat_ws(">", "from_id", "to_id"), F.concat(F.lit("  "), quote("from_id"), F.lit(" -> "), quote("to_id"), F.lit(";")))
    ends = nodes.sparkSession.sql("SELECT 0 part, '' id, 'digraph calls {' line UNION ALL SELECT 3, '', '}'")
    return n.union(e).union(ends).orderBy("part", "id", "line")
