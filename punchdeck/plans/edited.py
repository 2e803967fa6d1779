"""Queries over edited sources (documents) and over jobs (an order each, with a step for each of its items)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from punchdeck.plans.analogues import Query, t
from punchdeck.operators import rules
from punchdeck.operators.graph import shared_folder
from punchdeck.sources import edits, jcl, procs, store

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def texts(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("source"), F.regexp_replace(F.coalesce("text", F.lit("")), "\r", " ").alias("text"), F.lit("utf-8").alias("code_page"))


DOCS = "(SELECT doc_id AS source, replace(coalesce(text, ''), chr(13), ' ') AS x FROM documents)"


@query(f"""
SELECT source, line::INT AS line, (strlen(array_to_string(list_slice(l, 1, line - 1), chr(10))) + CASE WHEN line > 1 THEN 1 ELSE 0 END + strlen(substring(l[line], 1, 4)))::BIGINT AS "offset"
FROM (SELECT source, string_split(x, chr(10)) AS l, unnest(range(1, len(string_split(x, chr(10))) + 1)) AS line FROM {DOCS})""")
def byte_offset_of_column(spark, d):
    """The byte offset of column 5 in each line."""
    rows = edits.lines(texts(spark, d))
    return edits.byte_offsets(rows.select("source", "line", F.lit(5).alias("col")), rows).select("source", "line", "offset")


@query(f"""
SELECT source, strlen(y)::BIGINT AS n_bytes, sha256(y) AS digest
FROM (SELECT source, 'first é' || chr(10) || CASE WHEN len(l) > 1 AND length(l[2]) >= 5 THEN array_to_string(list_concat(list_slice(l, 1, 1), [substring(l[2], 1, 2) || '漢字' || substring(l[2], 6)], list_slice(l, 3, len(l))), chr(10)) ELSE x END AS y
  FROM (SELECT source, x, string_split(x, chr(10)) AS l FROM {DOCS}))""")
def spliced_sources(spark, d):
    """A line put before the first, and characters 3 to 5 of the second line replaced where it has them."""
    docs = texts(spark, d)
    rows = edits.lines(docs)
    first = docs.select("source", F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit(1).alias("end_line"), F.lit(1).alias("end_col"), F.lit("first é\n").alias("replacement"))
    second = rows.filter((F.col("line") == 2) & (F.length("text") >= 5)).select("source", F.lit(2), F.lit(3), F.lit(2), F.lit(6), F.lit("漢字"))
    done = edits.spliced(docs.withColumn("content", F.encode("text", "UTF-8")), edits.placed(first.union(second), rows))
    return done.select("source", F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


#: A job of an order: its items are steps, ``k`` their number. One that was returned runs under an IF, every third quantity has a COND,
#: those of every fourth supplier run a procedure, and tax 0.05 names a step that isn't there.
STEP = """concat(
  CASE WHEN l_returnflag = 'R' THEN concat('//  IF (S', k, 'X.RC = 0 |', chr(10), '//     ABEND) THEN', chr(10)) ELSE '' END,
  '//S', k, CASE WHEN l_suppkey % 4 = 0 THEN ' EXEC P1' ELSE ' EXEC PGM=A' END,
  CASE WHEN l_quantity % 3 = 0 THEN concat(',COND=(', CASE WHEN l_quantity % 2 = 0 THEN '0,LE' ELSE '4,LT' END, CASE WHEN l_tax = 0.05 THEN ',GONE' ELSE '' END, ')') ELSE '' END,
  CASE WHEN l_returnflag = 'R' THEN concat(chr(10), '//  ENDIF') ELSE '' END)"""
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
PROCEDURE = "//P1 PROC\n//PA EXEC PGM=B\n//  IF PA.RC = 0 THEN\n//PB EXEC PGM=C\n//  ELSE\n//PC EXEC PGM=D\n//  ENDIF\n//PD EXEC PGM=E\n//  PEND\n"


def jobs(spark, d):
    items = t(spark, d, "lineitem").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)))
    steps = items.select("l_orderkey", "k", F.expr(STEP).alias("x")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("steps"))
    text = F.concat(F.lit("//J JOB\n"), F.array_join(F.transform("steps", lambda s: s["x"]), "\n"))
    own = jcl.guarded(jcl.parse(steps.select(F.col("l_orderkey").cast("string").alias("path"), text.alias("text"))))
    members = jcl.guarded(jcl.parse(spark.createDataFrame([("P1", PROCEDURE)], "path string, text string")))
    return procs.expanded(own, members, with_dds=False)[0]


ITEMS_SQL = f"""
WITH i AS (
  SELECT l_orderkey::VARCHAR AS file, l_suppkey % 4 = 0 AS call, l_quantity % 3 = 0 AS cond, l_quantity % 6 = 0 AS skips, l_returnflag = 'R' AS guard, l_quantity % 3 = 0 AND l_tax = 0.05 AS gone,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS k, count(*) OVER (PARTITION BY l_orderkey) AS m
  FROM lineitem),
s AS (SELECT *, 1 + sum(1 + 3 * guard::INT) OVER (PARTITION BY file ORDER BY k) - guard::INT AS line FROM i),
bare AS (
  SELECT file, k, 0 AS part, line, 'S' || k AS step FROM s WHERE k > 1 AND NOT cond AND NOT guard
  UNION ALL SELECT file, k, 4, 8, 'S' || k || '.PD' FROM s WHERE call AND k = 1 AND NOT cond AND NOT guard)
SELECT 'R030' AS rule_id, 'warning' AS level, file, arg_min(line, k * 10 + part)::INT AS line, 'steps run whatever the steps before returned: ' || array_to_string(list_slice(list(step ORDER BY k, part), 1, 5), ', ')
  || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END AS message FROM bare GROUP BY file
UNION SELECT 'R046', 'warning', file, CASE WHEN call THEN 8 ELSE line END::INT, 'last step is skipped when all goes well: S' || k || CASE WHEN call THEN '.PD' ELSE '' END FROM s WHERE k = m AND (m >= 2 OR call) AND skips
UNION SELECT 'R047', 'error', file, line::INT, 'no earlier step is called ' || CASE WHEN gone THEN 'GONE' ELSE 'S' || k || 'X' END FROM s WHERE gone OR guard
UNION SELECT 'R047', 'error', file, unnest([2, 4, 6, 8])::INT, 'no earlier step is called GONE' FROM s WHERE gone AND call
"""


@query(ITEMS_SQL)
def job_step_rules(spark, d):
    """Rules of steps under IF and within procedures."""
    return rules.step_rules(jobs(spark, d))


@query(f"""
SELECT source, CASE WHEN source % 7 = 0 THEN 'removed' WHEN source % 5 = 0 THEN 'changed' WHEN source % 11 = 0 THEN 'added' END AS change,
  CASE WHEN source % 7 = 0 THEN 0 ELSE len(list_filter(string_split(CASE WHEN source % 5 = 0 THEN x || chr(10) || 'more' ELSE x END, chr(10)), lambda l: l <> '')) END::BIGINT AS n_lines
FROM {DOCS}""")
def stored_changes(spark, d):
    """A store of the documents' lines, brought up to date once: some are new, some have changed, some are gone."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"

    def facts(sources):
        return {"lines": sources.select("source", F.posexplode(F.split("text", "\n")).alias("seq", "line")).filter("line <> ''")}

    docs = texts(spark, d)
    first = docs.filter("source % 11 <> 0 or source % 5 = 0 or source % 7 = 0")
    later = docs.filter("source % 7 <> 0").withColumn("text", F.when(F.col("source") % 5 == 0, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")))
    keyed = [x.withColumns({"source": F.col("source").cast("string"), "key": store.content_key(F.col("text"), "utf-8")}) for x in (first, later)]
    store.update(root, keyed[0], facts)
    change = store.update(root, keyed[1], facts)
    n = store.read(spark, root, "lines").groupBy("source").agg(F.count("*").alias("n_lines"))
    every = docs.select("source").withColumn("key_", F.col("source").cast("string"))
    out = every.join(change.withColumnRenamed("source", "key_"), "key_", "left").join(n.withColumnRenamed("source", "key_"), "key_", "left")
    return out.select("source", "change", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))
