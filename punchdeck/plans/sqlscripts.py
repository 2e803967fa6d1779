"""Queries over SQL scripts, one for each document: its id chooses the variant, its text stands in a comment.

The SQL of the same rows puts each statement together by itself and never looks for where one ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punchdeck.operators import sqlscope
from punchdeck.operators.graph import cut
from punchdeck.plans.analogues import Query, t
from punchdeck.sources import scripts

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Parts of a script as SQL expressions over the id ``d``.
TABLE = "concat('S', d % 3, '.T', d % 50)"
CREATE = f"concat('CREATE TABLE ', {TABLE}, ' (ID INTEGER NOT NULL, NAME CHAR(10), QTY DECIMAL(5, 2))')"
INSERT = f"concat('INSERT INTO ', {TABLE}, ' VALUES (1, ''a;b'', 2)')"
SELECT = f"concat('SELECT ', CASE WHEN d % 2 = 0 THEN '*' ELSE 'ID, NAME' END, ' FROM ', {TABLE}, chr(10), '  WHERE EXISTS (SELECT * FROM ', {TABLE}, ' X WHERE X.ID = ', CASE WHEN d % 5 = 0 THEN 'QTX' ELSE 'QTY' END, ')')"
UPDATE = f"concat('UPDATE ', {TABLE}, ' SET QTY = CASE WHEN V = 1 THEN 0 ELSE 1 END WHERE ', CASE WHEN d % 3 = 0 THEN 'UPPER(NAME)' ELSE 'NAME' END, ' = ''END''')"
DELETE = f"concat('DELETE FROM ', {TABLE})"
INNER = f"concat('BEGIN ', {DELETE}, '; END')"
ROUTINE = f"concat('CREATE PROCEDURE S.P', d, ' (IN V INTEGER)', chr(10), 'BEGIN -- not; here', chr(10), ' ', {UPDATE}, ';', chr(10), ' ', {INNER}, ';', chr(10), 'END')"


def sources(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, text)``: the scripts."""
    note = "replace(coalesce(text, ''), '*/', '* /')"
    parts = f"""concat('-- script ', d, '; a note', chr(10), '/* ', {note}, ' */', chr(10), {CREATE}, '; ', {INSERT}, ' /* ; */;', chr(10), {SELECT}, ';', chr(10),
      '--#SET TERMINATOR @', chr(10), {ROUTINE}, '@', chr(10), 'TERMINATOR ;', chr(10), 'COMMIT')"""
    return t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("d"), "text").select("doc_id", F.expr(parts).alias("text"))


#: Rows of the outermost statements: number, text, lines below the CREATE TABLE, column.
TOP = [(1, CREATE, 0, "1"), (2, INSERT, 0, f"length({CREATE}) + 3"), (3, SELECT, 1, "1"), (4, ROUTINE, 4, "1"), (5, "'COMMIT'", 10, "1")]
#: The note has a line more than it has breaks.
BASE = "3 + length(x) - length(replace(x, chr(10), ''))"
DOCS = "(SELECT doc_id AS d, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS x FROM documents)"


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(" UNION ALL ".join(f"""
SELECT d AS script, {n} AS nth, q AS text, ({BASE} + {down})::INT AS line, ({col})::INT AS col, ({BASE} + {down} + length(q) - length(replace(q, chr(10), '')))::INT AS end_line,
  (length(string_split(q, chr(10))[-1]) + CASE WHEN contains(q, chr(10)) THEN 0 ELSE {col} - 1 END)::INT AS end_col
FROM (SELECT *, {text} AS q FROM {DOCS})""" for n, text, down, col in TOP))  # fmt: skip
def sql_statements(spark, d):
    return scripts.statements(sources(spark, d), "doc_id", "text")


NESTED = [(f"{n}", text, down) for n, text, down, _ in TOP] + [("4.1", UPDATE, 6), ("4.2", INNER, 7), ("4.2.1", DELETE, 7)]


@query(" UNION ALL ".join(f"SELECT d AS script, '{path}' AS path, ({BASE} + {down})::INT AS line, {text} AS text FROM {DOCS}" for path, text, down in NESTED))
def sql_nested(spark, d):
    return scripts.nested(sources(spark, d), "doc_id", "text").select("script", F.array_join("path", ".").alias("path"), "line", "text")


@query(f"SELECT d AS script, 4 AS nth, 'PROCEDURE' AS kind, 'S.P' || d AS name, ({BASE} + 4)::INT AS line, 3::BIGINT AS n_statements FROM {DOCS}")
def sql_routines(spark, d):
    return scripts.routines(scripts.nested(sources(spark, d), "doc_id", "text"))


def keyed(nested: DataFrame) -> DataFrame:
    """``(stmt, text)`` of statements that hold no others; ``stmt`` is SCRIPT/PATH."""
    return nested.filter(~F.col("text").rlike(r"\bBEGIN\b")).select(F.concat_ws("/", F.col("script").cast("string"), F.array_join("path", ".")).alias("stmt"), "text")


NAMES = [
    ("3", "'ID'", "d % 2 = 1", "0"), ("3", "'NAME'", "d % 2 = 1", "0"), ("3", "'ID'", "true", "1"), ("3", "'QTY'", "d % 5 <> 0", "1"), ("3", "'QTX'", "d % 5 = 0", "1"),
    ("4.1", "'QTY'", "true", "0"), ("4.1", "'V'", "true", "0"), ("4.1", "'NAME'", "true", "0"),
]


@query(" UNION ALL ".join(f"""
SELECT d || '/{path}' AS stmt, {name} AS name, {inner} AS inner, CASE WHEN {name} = 'QTX' THEN NULL ELSE {TABLE} END AS "table", {name} IN ('QTX', 'V') AS missing, count(*) AS n
FROM {DOCS} WHERE {holds} GROUP BY ALL""" for path, name, holds, inner in NAMES))  # fmt: skip
def sql_names(spark, d):
    stmts = keyed(scripts.nested(sources(spark, d), "doc_id", "text"))
    rows = cut(sqlscope.tokens(stmts.filter(~F.col("text").startswith("CREATE"))))
    found = sqlscope.resolved(sqlscope.columns(rows), sqlscope.levels(rows), sqlscope.with_declarations(sqlscope.sources(rows), sqlscope.declared(stmts)))
    return found.groupBy("stmt", "name", F.when(F.col("block") > 0, 1).otherwise(0).alias("inner"), "table", "missing").agg(F.count("*").alias("n"))


@query(f"""
SELECT d || '/3' AS stmt, 'S001' AS rule_id, '*' AS detail FROM {DOCS} WHERE d % 2 = 0
UNION ALL SELECT d || '/4.1', 'S002', 'function' FROM {DOCS} WHERE d % 3 = 0
UNION ALL SELECT d || '/3', 'R057', '?.QTX' FROM {DOCS} WHERE d % 5 = 0""")
def sql_findings(spark, d):
    nested = scripts.nested(sources(spark, d), "doc_id", "text")
    stmts = keyed(nested)
    known = scripts.variables(nested).select(F.concat_ws("/", F.col("script").cast("string"), F.col("nth").cast("string")).alias("routine"), "name")
    held = stmts.select("stmt", F.substring_index("stmt", ".", 1).alias("routine")).join(known, "routine").select("stmt", "name")
    return sqlscope.findings(stmts, held, ~F.col("text").startswith("CREATE"))


#: One statement a document, by its id: text, and what it does to A and to S.B.
ACCESS = [
    ("MERGE INTO A USING S.B X ON A.K = X.K WHEN MATCHED THEN UPDATE SET V = X.V", "U", "R"), ("MERGE INTO A USING S.B X ON A.K = X.K WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (K) VALUES (X.K)", "CD", "R"),
    ("LOCK TABLE A IN EXCLUSIVE MODE", "U", None), ("LOCK TABLE S.B IN SHARE MODE", None, "R"), ("INSERT INTO A (K) SELECT K FROM S.B", "C", "R"), ("TRUNCATE TABLE S.B", None, "D"),
    ("UPDATE S.B SET V = (SELECT MAX(V) FROM A WHERE A.K = 1) WHERE K IN (SELECT K FROM S.B)", "R", "RU"), ("DELETE FROM A WHERE NOT EXISTS (SELECT 1 FROM S.B, A Z WHERE Z.K = 2)", "RD", "R"),
    ("SELECT K FROM A UNION SELECT K FROM S.B", "R", "R"), ("DECLARE C CURSOR FOR SELECT K FROM A", "R", None),
]


def chosen_access(column: int) -> str:
    return f"CASE d % {len(ACCESS)} " + " ".join(f"WHEN {k} THEN {repr(a[column]) if a[column] else 'NULL'}" for k, a in enumerate(ACCESS)) + " END"


@query(f"""SELECT stmt, "table", letters FROM (SELECT d AS stmt, 'A' AS "table", {chosen_access(1)} AS letters FROM {DOCS} UNION ALL SELECT d, 'S.B', {chosen_access(2)} FROM {DOCS}) WHERE letters IS NOT NULL""")
def sql_access(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("stmt"), F.col("doc_id").alias("d"))
    return sqlscope.table_access(docs.select("stmt", F.expr(chosen_access(0)).alias("text")))
