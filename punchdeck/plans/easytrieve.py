"""Queries over Easytrieve programs, one for each document: its id chooses the variant, its text is what the comments hold.

Macro members are made of ``nation`` and ``region``: a nation's calls its region's. The SQL of the same rows works from the ids
and knows nothing of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punchdeck.operators import easytrieve as ops
from punchdeck.operators.graph import cut
from punchdeck.plans.analogues import Query, t
from punchdeck.sources import copybooks, easytrieve, jcl

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PREFIX = "concat('W-', d % 10)"
#: Lines below the comments, as SQL expressions over the id ``d``; a null is a comment line.
LINES = [
    "concat('FILE SALES FB(', 80 + d % 40, ' 1000)')", "' S-ID 1 5 N. S-AMT * 7 N 2.  * both'", "' S-DATE * +2 8 A'", "' S-YEAR S-DATE 4 A'", "' S-MON S-YEAR +4 2 N'", "' S-TAIL 86 10 A'",
    "concat('FILE OUT VS', CASE WHEN d % 7 = 0 THEN ' PASSWORD ''X''' ELSE '' END)", "'MSTART OWN'", "'MACRO 1 F KEY OUT'", "' GET &F. .'", "' PUT &key'", "'MEND'",
    f"concat('%N', d % 30, ' ', {PREFIX}, ' LEN ', 3 + d % 5)", "CASE WHEN d % 3 = 0 THEN 'SORT SALES TO OUT USING (S-ID)' END",
    "concat('JOB', CASE d % 4 WHEN 0 THEN ' INPUT NULL' WHEN 1 THEN '' WHEN 2 THEN ' INPUT SALES' ELSE ' INPUT (OUT KEY (S-ID))' END)", "concat(' %OWN SALES', CASE WHEN d % 2 = 1 THEN ' KEY SALES' ELSE '' END)",
    "CASE WHEN d % 5 = 0 THEN ' STOP' END", f"concat(' ', {PREFIX}, 'TOTAL = ', {PREFIX}, 'TOTAL +')", "'   + S-AMT'", "CASE WHEN d % 6 = 0 THEN ' IF S-AMT NOT NUMERIC' END", "CASE WHEN d % 6 = 0 THEN '   DISPLAY ''A. B'' END-IF-X' END",
    "CASE WHEN d % 6 = 0 THEN ' END-IF' END", "CASE WHEN d % 8 = 0 THEN '%MISSING' END", "'SPARE. PROC'", "concat(' CALL SUB', d % 9)", "'END-PROC'",
]
DOCS = "(SELECT doc_id AS d, regexp_replace(coalesce(text, ''), '\\r\\n?|\\x{85}', chr(10), 'g') AS x FROM documents)"
BASE = "1 + length(x) - length(replace(x, chr(10), ''))"
#: The members that the document's call brings in.
BROUGHT = f"{DOCS} JOIN nation ON n_nationkey = d % 30"
JOB = "CASE WHEN d % 3 = 0 THEN 2 ELSE 1 END"


def sources(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, text)``: the programs."""
    notes = r"concat('* ', regexp_replace(coalesce(text, ''), '\r\n|\r|\n|\u0085', '\n* '))"
    parts = [notes] + [f"coalesce({x}, '* -')" for x in LINES]
    return t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("d"), "text").select("doc_id", F.expr(f"concat_ws('\n', {', '.join(parts)})").alias("text"))


def members(spark: SparkSession, d: str) -> DataFrame:
    nations = t(spark, d, "nation").selectExpr("concat('maclib/N', n_nationkey, '.mac') AS path", r"concat('* ', n_name, '\nMACRO 1 P LEN 4\n &P.TOTAL W &LEN P 2\n%R', n_regionkey, ' &P') AS text")
    regions = t(spark, d, "region").selectExpr("concat('maclib/R', r_regionkey, '.mac') AS path", r"'MACRO P\n &P.COUNT W 4 B' AS text")
    return easytrieve.library(nations.union(regions), "path", "text")


def read(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, macros = easytrieve.expanded(sources(spark, d), "doc_id", "text", members(spark, d))
    return easytrieve.placed(rows), macros


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: Statements of the source: lines below the comments, condition, words, role, activity, depth.
OWN = [
    (1, "true", "concat('FILE SALES FB ( ', 80 + d % 40, ' 1000 )')", "library", "0", 0), (2, "true", "'S-ID 1 5 N'", "library", "0", 0), (2, "true", "'S-AMT * 7 N 2'", "library", "0", 0),
    (3, "true", "'S-DATE * +2 8 A'", "library", "0", 0), (4, "true", "'S-YEAR S-DATE 4 A'", "library", "0", 0), (5, "true", "'S-MON S-YEAR +4 2 N'", "library", "0", 0), (6, "true", "'S-TAIL 86 10 A'", "library", "0", 0),
    (7, "true", LINES[6], "library", "0", 0), (14, "d % 3 = 0", "'SORT SALES TO OUT USING ( S-ID )'", "activity", "1", 0),
    (15, "true", "concat('JOB', CASE d % 4 WHEN 0 THEN ' INPUT NULL' WHEN 1 THEN '' WHEN 2 THEN ' INPUT SALES' ELSE ' INPUT ( OUT KEY ( S-ID ) )' END)", "activity", JOB, 0),
    (10, "true", "'GET SALES'", "statement", JOB, 0), (11, "true", "concat('PUT ', CASE WHEN d % 2 = 1 THEN 'SALES' ELSE 'OUT' END)", "statement", JOB, 0), (17, "d % 5 = 0", "'STOP'", "statement", JOB, 0),
    (18, "true", f"concat({PREFIX}, 'TOTAL = ', {PREFIX}, 'TOTAL + S-AMT')", "statement", JOB, 0), (20, "d % 6 = 0", "'IF S-AMT NOT NUMERIC'", "statement", JOB, 0), (21, "d % 6 = 0", "'DISPLAY ''A. B'' END-IF-X'", "statement", JOB, 1),
    (22, "d % 6 = 0", "'END-IF'", "statement", JOB, 0), (24, "true", "'SPARE'", "proc", JOB, 0), (25, "true", "concat('CALL SUB', d % 9)", "statement", JOB, 0),
]


@query(" UNION ALL ".join(f"""
SELECT d AS program, NULL AS file, ({BASE} + {down})::INT AS line, {words} AS words, '{role}' AS role, ({activity})::INT AS activity, {depth} AS depth FROM {DOCS} WHERE {holds}""" for down, holds, words, role, activity, depth in OWN) + f"""
UNION ALL SELECT d, 'maclib/N' || n_nationkey || '.mac', 3, concat({PREFIX}, 'TOTAL W ', 3 + d % 5, ' P 2'), 'library', 0, 0 FROM {BROUGHT}
UNION ALL SELECT d, 'maclib/R' || n_regionkey || '.mac', 2, concat({PREFIX}, 'COUNT W 4 B'), 'library', 0, 0 FROM {BROUGHT}""")  # fmt: skip
def ezt_statements(spark, d):
    return read(spark, d)[0].select("program", "file", "line", F.array_join("words", " ").alias("words"), "role", "activity", "depth")


FIELDS = [("S-ID", 1, 5, "N", 0), ("S-AMT", 6, 7, "N", 2), ("S-DATE", 15, 8, "A", 0), ("S-YEAR", 15, 4, "A", 0), ("S-MON", 19, 2, "N", 0), ("S-TAIL", 86, 10, "A", 0)]


@query(" UNION ALL ".join(f"SELECT d AS program, '{name}' AS name, 'SALES' AS file, {start} AS start, {start + length - 1} AS last, {length} AS length, '{kind}' AS type, {decimals} AS decimals FROM {DOCS}" for name, start, length, kind, decimals in FIELDS) + f"""
UNION ALL SELECT d, {PREFIX} || 'TOTAL', NULL, NULL, NULL, (3 + d % 5)::INT, 'P', 2 FROM {BROUGHT}
UNION ALL SELECT d, {PREFIX} || 'COUNT', NULL, NULL, NULL, 4, 'B', 0 FROM {BROUGHT}""")  # fmt: skip
def ezt_fields(spark, d):
    return ops.fields(read(spark, d)[0]).select("program", "name", "file", "start", "last", "length", "type", "decimals")


@query(f"""
SELECT d AS program, 'SALES' AS file, CASE WHEN d % 2 = 1 THEN 'UPDATE' ELSE 'READ' END AS access FROM {DOCS}
UNION ALL SELECT d, 'OUT', CASE WHEN r AND w THEN 'UPDATE' WHEN r THEN 'READ' ELSE 'WRITE' END
FROM (SELECT d, d % 4 = 3 OR (d % 4 = 1 AND d % 3 = 0) AS r, d % 3 = 0 OR d % 2 = 0 AS w FROM {DOCS}) WHERE r OR w""")
def ezt_file_uses(spark, d):
    rows = read(spark, d)[0]
    return ops.file_uses(rows, ops.files(rows))


@query(f"""
SELECT d AS program, ({BASE} + 6)::INT AS line, 'R098' AS rule_id, 'S-TAIL' AS subject FROM {DOCS} WHERE 80 + d % 40 < 95
UNION ALL SELECT d, ({BASE} + 7)::INT, 'R103', 'OUT' FROM {DOCS} WHERE d % 7 = 0
UNION ALL SELECT d, ({BASE} + 15)::INT, 'R097', 'JOB' FROM {DOCS} WHERE d % 4 = 0 AND d % 5 <> 0
UNION ALL SELECT d, ({BASE} + 10)::INT, 'R101', 'SALES' FROM {DOCS}
UNION ALL SELECT d, ({BASE} + 18)::INT, 'R100', 'S-AMT' FROM {DOCS} WHERE d % 6 <> 0
UNION ALL SELECT d, ({BASE} + 24)::INT, 'R105', 'SPARE' FROM {DOCS}
UNION ALL SELECT d, ({BASE} + 13)::INT, 'R106', 'N' || d % 30 FROM {DOCS} WHERE d % 30 NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT d, ({BASE} + 23)::INT, 'R106', 'MISSING' FROM {DOCS} WHERE d % 8 = 0""")
def ezt_findings(spark, d):
    return ops.findings(*read(spark, d)).select("program", "line", "rule_id", "subject")


@query(f"SELECT d AS program, ({BASE} + 25)::INT AS line, 'CALL' AS verb, 'SUB' || d % 9 AS target, true AS literal FROM {DOCS}")
def ezt_calls(spark, d):
    return ops.calls(read(spark, d)[0])


#: A job for each document that compiles and runs a program in its SYSIN.
JCL = [
    "concat('//J', d, ' JOB')", "'//S1 EXEC PGM=EZTPA00'", "CASE WHEN d % 3 = 0 THEN '//*' ELSE '//SALES DD DSN=A.B,DISP=SHR' END", "'//OUT DD SYSOUT=*'", "'//SYSIN DD *'", "'FILE SALES FB(80 800)'", "'FILE OUT'", "'FILE SPARE'", "'FILE W VIRTUAL'",
    "'JOB INPUT SALES'", "CASE WHEN d % 2 = 0 THEN ' GET SPARE' ELSE ' GET W' END", "' PUT OUT'", "'/*'", "'//S2 EXEC PGM=EZTPA00'", "'//SYSIN DD DSN=MY.SOURCE'",
]


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """``(path, text)``: the jobs; the document's text is what comments of the program hold."""
    notes = r"concat('* ', regexp_replace(coalesce(text, ''), '\r\n|\r|\n|\u0085', '\n* '))"
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("d"), "text")
    return rows.select(F.col("d").cast("string").alias("path"), F.expr(f"concat_ws('\n', {', '.join(JCL[:5] + [notes] + JCL[5:])})").alias("text"))


@query(f"""
SELECT d || ':J' || d || '.S1' AS program, 'SALES' AS file, 'J' || d AS job, 'S1' AS step FROM {DOCS} WHERE d % 3 = 0
UNION ALL SELECT d || ':J' || d || '.S1', 'SPARE', 'J' || d, 'S1' FROM {DOCS} WHERE d % 2 = 0""")
def ezt_unallocated(spark, d):
    _, steps, dds = jcl.facts(jcl.parse(jobs(spark, d)))
    steps, dds = cut(steps), cut(dds)
    held = easytrieve.under_steps(steps, dds)
    rows = easytrieve.placed(easytrieve.expanded(held, "program", "text")[0])
    files = ops.files(rows)
    named = F.concat(F.col("file"), F.lit(":"), F.col("job"))
    found = ops.unallocated(files, ops.file_uses(rows, files), steps.select(named.alias("job"), "step", F.concat_ws(".", named, "step").alias("program")), dds.filter("opens").select(named.alias("job"), "step", "dd"))
    return found.select("program", "file", F.element_at(F.split("job", ":"), -1).alias("job"), "step")


@query("""
SELECT doc_id AS program, 'C' || k AS name,
  CASE WHEN k >= 25 THEN NULL WHEN k >= 20 AND k % 2 = 0 THEN 'lib2/C' || k || '.COPY' ELSE 'lib' || (k % 2 + 1) || '/C' || k || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '.cpy' ELSE '.CPY' END END AS path
FROM (SELECT doc_id, doc_id % 40 AS k FROM documents)""")
def copybooks_resolved(spark, d):
    nations = t(spark, d, "nation").selectExpr("concat('lib', n_nationkey % 2 + 1, '/C', n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.cpy' ELSE '.CPY' END) AS path")
    more = t(spark, d, "region").selectExpr("explode(array(concat('lib2/C', r_regionkey + 20, '.COPY'), concat('other/C', r_regionkey + 30, '.cpy'), concat('lib2/deep/C', r_regionkey + 30, '.cpy'))) AS path")
    folders = t(spark, d, "region").filter("r_regionkey < 2").selectExpr("concat('lib', 2 - r_regionkey, '/') AS folder", "r_regionkey AS rank")
    uses = t(spark, d, "documents").selectExpr("doc_id AS program", "concat('C', doc_id % 40) AS name")
    return copybooks.resolved(uses, copybooks.called(nations.union(more), folders)).select("program", "name", "path")
