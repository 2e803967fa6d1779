"""Queries over COBOL programs, one for each document: its id chooses the variant of the program, its text is what the comments hold.

The programs are text until the engine reads them; the SQL of the same rows knows none of it and works from the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punchdeck.operators import control, flow, intervals, operands, path_rules, program_rules
from punchdeck.plans.analogues import Query, t
from punchdeck.sources import cobol

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Lines of a program: number, condition, text as an SQL expression over the id ``d``; the comments follow line 12.
LINES: list[tuple[int, str, str]] = [
    (1, "true", "'       IDENTIFICATION DIVISION.'"), (2, "true", "concat('       PROGRAM-ID. P', d, '.')"), (3, "true", "'       DATA DIVISION.'"), (4, "true", "'       WORKING-STORAGE SECTION.'"),
    (5, "true", "concat('       01  WS-A PIC S9(', 1 + d % 5, ')V99 COMP-3', CASE WHEN d % 2 = 0 THEN ' VALUE ZERO' ELSE '' END, '.')"), (6, "true", "'       01  WS-TAB.'"),
    (7, "true", "concat('           05  WS-E OCCURS ', 5 + d % 7, ' TIMES PIC 9(4) USAGE IS BINARY VALUE 0.')"), (8, "true", "'       77  WS-I PIC 9(4) VALUE 1.'"),
    (9, "true", "'       77  WS-L PIC X(20) VALUE \"a. MOVE\".'"), (10, "true", "'       77  WS-N PIC 9(4) VALUE 9.'"), (11, "true", "concat('       77  WS-M PIC 9(', 1 + d % 4, ').')"), (12, "true", "'      * PROCEDURE DIVISION.'"),
    (20, "true", "'       PROCEDURE DIVISION.'"), (21, "true", "'       MAIN SECTION.'"), (22, "true", "'       P-START.'"),
    (28, "true", "'           MOVE WS-N TO WS-M'"), (29, "true", "concat('           COMPUTE WS-N = ', d % 12, ' - 5')"), (30, "true", "'           IF WS-L = \"END-IF\" OR WS-I > 1'"), (31, "true", "'              MOVE 1 TO WS-A'"),
    (32, "d % 3 = 0", "'           ELSE MOVE 2 TO WS-A'"), (33, "true", "'           END-IF'"), (34, "true", "'           DISPLAY WS-A'"), (35, "true", "'           EVALUATE WS-I'"),
    (36, "true", "'             WHEN 1 PERFORM P-WORK'"), (37, "d % 5 <> 0", "'             WHEN OTHER CONTINUE'"), (38, "true", "'           END-EVALUATE'"),
    (39, "true", "concat('           PERFORM VARYING WS-I FROM 1 BY 1 UNTIL WS-I > ', 3 + d % 9)"), (40, "true", "'              ADD WS-E(WS-I) TO WS-A'"), (41, "true", "'           END-PERFORM'"),
    (42, "d % 4 = 0", "'           GO TO P-END'"), (43, "d % 12 = 0", "'           MOVE 3 TO WS-I'"), (44, "d % 4 <> 0", "'           PERFORM P-WORK THRU P-END'"),
    (45, "d % 6 = 1", "'           ALTER P-START TO PROCEED TO P-WORK'"), (46, "true", "'           .'"), (50, "true", "'       P-WORK.'"), (51, "true", "'           MOVE 7 TO WS-A.'"),
    (60, "true", "'       OTHER SECTION.'"), (61, "true", "'       P-END.'"), (62, "true", "'           STOP RUN.'"), (70, "true", "'       P-SPARE.'"), (71, "true", "'           ADD 1 TO WS-I'"),
    (72, "true", "'           GOBACK.'"), (80, "d % 8 = 3", "'       P-SPARE.'"), (81, "d % 8 = 3", "'           EXIT.'"),
]


def programs(spark: SparkSession, d: str, lines: list[tuple[int, str, str]] = LINES) -> DataFrame:
    """``(doc_id, text)``: the sources."""
    shown = "concat('      * ', replace(coalesce(text, ''), '\\n', '\\n      * '))"
    parts = [f"CASE WHEN {c} THEN {x} END" for n, c, x in lines if n <= 12] + [shown] + [f"CASE WHEN {c} THEN {x} END" for n, c, x in lines if n > 12]
    rows = t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("d"), "text")
    return rows.select("doc_id", F.expr(f"array_join(array({', '.join(parts)}), '\\n')").alias("text"))


def rows_of(select: str, rows: list[str], columns: str, source: list[tuple[int, str, str]] = LINES) -> str:
    """SQL: ``select`` over all documents and ``rows`` with numbers of lines, ``x`` being the lines that are there."""
    lines = ", ".join(f"({n}, {k})" for k, (n, _, _) in enumerate(source))
    there = "CASE k " + " ".join(f"WHEN {k} THEN {c}" for k, (_, c, _) in enumerate(source)) + " END"
    return f"""
WITH x AS (
  SELECT d, n, (row_number() OVER (PARTITION BY d ORDER BY n) + CASE WHEN n > 12 THEN more ELSE 0 END)::INT AS line
  FROM (SELECT doc_id AS d, 1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS more FROM documents), (VALUES {lines}) v(n, k) WHERE {there}),
s AS (SELECT d, n, line, row_number() OVER (PARTITION BY d ORDER BY n)::INT AS stmt FROM x WHERE n IN ({", ".join(str(n) for n in STATEMENTS)})),
r({columns}) AS (VALUES {", ".join(rows)})
{select}"""


#: Statements by line: verb, line of what holds them, branch.
STATEMENTS: dict[int, tuple[str, int, str | None]] = {
    28: ("MOVE", 0, None), 29: ("COMPUTE", 0, None), 30: ("IF", 0, None), 31: ("MOVE", 30, "THEN"), 32: ("MOVE", 30, "ELSE"), 34: ("DISPLAY", 0, None), 35: ("EVALUATE", 0, None), 36: ("PERFORM", 35, "WHEN 1"),
    37: ("CONTINUE", 35, "WHEN OTHER"), 39: ("PERFORM", 0, None), 40: ("ADD", 39, "BODY"), 42: ("GO", 0, None), 43: ("MOVE", 0, None), 44: ("PERFORM", 0, None), 45: ("ALTER", 0, None), 51: ("MOVE", 0, None),
    62: ("STOP", 0, None), 71: ("ADD", 0, None), 72: ("GOBACK", 0, None), 81: ("EXIT", 0, None),
}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def sources(spark: SparkSession, d: str) -> tuple[DataFrame, str, str]:
    return programs(spark, d), "doc_id", "text"


ITEMS = [
    "(5, 1, 1, 'WS-A', 'COMP-3', NULL, NULL)", "(6, 2, 1, 'WS-TAB', NULL, NULL, NULL)", "(7, 3, 5, 'WS-E', 'COMP', NULL, '0')", "(8, 4, 77, 'WS-I', NULL, NULL, '1')",
    "(9, 5, 77, 'WS-L', NULL, NULL, '\"a. MOVE\"')", "(10, 6, 77, 'WS-N', NULL, NULL, '9')", "(11, 7, 77, 'WS-M', NULL, NULL, NULL)",
]


@query(rows_of("""
SELECT d AS program, idx::INT AS idx, line, level::INT AS level, name, CASE n WHEN 5 THEN 'S9(' || (1 + d % 5) || ')V99' WHEN 6 THEN NULL WHEN 9 THEN 'X(20)' WHEN 11 THEN '9(' || (1 + d % 4) || ')' ELSE '9(4)' END AS picture, usage,
  CASE WHEN n = 7 THEN (5 + d % 7)::INT END AS occurs, CASE WHEN n = 5 AND d % 2 = 0 THEN 'ZERO' ELSE value END AS value
FROM x JOIN r USING (n)""", ITEMS, "n, idx, level, name, usage, occurs, value"))  # fmt: skip
def cobol_items(spark, d):
    return cobol.data_items(cobol.tokens(*sources(spark, d))).select("program", "idx", "line", "level", "name", "picture", "usage", "occurs", "value")


@query(rows_of("SELECT d AS program, row_number() OVER (PARTITION BY d ORDER BY n)::INT AS idx, name, kind, section, line FROM x JOIN r USING (n)", [
    "(21, 'MAIN', 'SECTION', 'MAIN')", "(22, 'P-START', 'PARAGRAPH', 'MAIN')", "(50, 'P-WORK', 'PARAGRAPH', 'MAIN')", "(60, 'OTHER', 'SECTION', 'OTHER')", "(61, 'P-END', 'PARAGRAPH', 'OTHER')",
    "(70, 'P-SPARE', 'PARAGRAPH', 'OTHER')", "(80, 'P-SPARE', 'PARAGRAPH', 'OTHER')",
], "n, name, kind, section"))
def cobol_procedures(spark, d):
    return cobol.procedures(cobol.tokens(*sources(spark, d)))


@query(rows_of("""
SELECT s.d AS program, s.stmt, s.line, verb, coalesce(p.stmt, 0) AS parent, branch
FROM s JOIN r USING (n) LEFT JOIN s p ON p.d = s.d AND p.n = r.held""", [f"({n}, '{v}', {p}, {repr(b) if b else 'NULL'})" for n, (v, p, b) in STATEMENTS.items()], "n, verb, held, branch"))  # fmt: skip
def cobol_statements(spark, d):
    return cobol.statements(cobol.tokens(*sources(spark, d))).select("program", "stmt", "line", "verb", "parent", "branch")


#: Edges by line, with conditions; 0 and -1 are the program's ends.
EDGES: list[tuple[int, int, str]] = [
    (0, 28, "true"), (28, 29, "true"), (29, 30, "true"), (30, 31, "true"), (31, 34, "true"), (30, 32, "true"), (32, 34, "true"), (30, 34, "d % 3 <> 0"), (34, 35, "true"), (35, 36, "true"), (35, 37, "true"), (35, 39, "d % 5 = 0"),
    (36, 39, "true"), (36, 51, "true"), (37, 39, "true"), (39, 40, "true"), (40, 39, "true"), (39, 42, "true"), (39, 44, "true"), (42, 62, "true"), (43, 51, "true"), (44, 51, "true"), (44, 45, "true"), (45, 51, "true"),
    (51, 62, "true"), (51, 39, "true"), (62, -1, "true"), (71, 72, "true"), (72, -1, "true"), (81, -1, "true"),
]
FLOW_SQL = rows_of(f"""
SELECT r_d AS program, CASE WHEN a = 0 THEN 0 ELSE f.stmt END AS from_node, CASE WHEN b = -1 THEN -1 ELSE g.stmt END AS to_node
FROM (SELECT doc_id AS r_d, a, b, CASE k {" ".join(f"WHEN {k} THEN {c.replace('d %', 'doc_id %')}" for k, (_, _, c) in enumerate(EDGES))} END AS holds FROM documents, r) q
LEFT JOIN s f ON f.d = r_d AND f.n = a LEFT JOIN s g ON g.d = r_d AND g.n = b
WHERE holds AND (a = 0 OR f.stmt IS NOT NULL) AND (b = -1 OR g.stmt IS NOT NULL)""", [f"({a}, {b}, {k})" for k, (a, b, _) in enumerate(EDGES)], "a, b, k")  # fmt: skip


@query(FLOW_SQL)
def cobol_flow(spark, d):
    tokens = program_rules.cut(cobol.tokens(*sources(spark, d)))
    return control.edges(program_rules.cut(cobol.statements(tokens)), cobol.procedures(tokens))


@query(rows_of("SELECT d AS program, stmt AS node, name, defined, used FROM s JOIN r USING (n)", [
    "(28, 'WS-N', false, true)", "(28, 'WS-M', true, false)", "(29, 'WS-N', true, false)", "(30, 'WS-L', false, true)", "(30, 'WS-I', false, true)", "(31, 'WS-A', true, false)", "(32, 'WS-A', true, false)", "(34, 'WS-A', false, true)", "(35, 'WS-I', false, true)",
    "(39, 'WS-I', true, false)", "(40, 'WS-E', false, true)", "(40, 'WS-I', false, true)", "(40, 'WS-A', true, true)", "(43, 'WS-I', true, false)", "(51, 'WS-A', true, false)", "(71, 'WS-I', true, true)",
], "n, name, defined, used"))
def cobol_operands(spark, d):
    # read three times below
    return operands.operands(program_rules.cut(cobol.statements(cobol.tokens(*sources(spark, d)))))


#: Findings by line.
FINDINGS = [
    ("R001", 34, "WS-A", "d % 2 = 1 AND d % 3 <> 0"), ("R008", 36, "P-WORK", "true"), ("R009", 42, "P-END", "true"), ("R010", 45, "ALTER", "true"), ("R011", 70, "P-SPARE", "true"),
    ("R011", 80, "P-SPARE", "true"), ("R011", 43, "MOVE", "true"), ("R013", 35, "EVALUATE", "d % 5 = 0"), ("R023", 80, "P-SPARE", "true"),
    ("R003", 28, "WS-M", "d % 4 < 3"), ("R005", 40, "WS-E", "3 + d % 9 > 5 + d % 7"), ("R028", 29, "WS-N", "d % 12 < 5"),
]


def findings_sql(found: list[tuple[str, int, str, str]], source: list[tuple[int, str, str]] = LINES) -> str:
    holds = "CASE k " + " ".join(f"WHEN {k} THEN {c}" for k, (_, _, _, c) in enumerate(found)) + " END"
    return rows_of(f"SELECT d AS program, line, rule_id, subject FROM x JOIN r USING (n) WHERE {holds}", [f"({n}, '{rule}', '{s}', {k})" for k, (rule, n, s, _) in enumerate(found)], "n, rule_id, subject, k", source)


@query(findings_sql(FINDINGS))
def cobol_findings(spark, d):
    return program_rules.program_rules(program_rules.sourced(*sources(spark, d)))


@query(f"""
WITH RECURSIVE e AS ({FLOW_SQL}),
reached(program, node) AS (SELECT program, 0 FROM e WHERE from_node = 0 UNION SELECT e.program, e.to_node FROM e JOIN reached ON e.program = reached.program AND e.from_node = reached.node)
SELECT program, node FROM reached""")
def cobol_reachable(spark, d):
    found = cobol_flow(spark, d)
    return flow.reachable(found, found.filter("from_node = 0").select("program", F.col("from_node").alias("node")))


#: Intervals by line: name, condition, bounds. What WS-A holds at the DISPLAY is 1 or 2 of the MOVEs, or 0 of its VALUE; the loop is met again from P-WORK.
LOW, HIGH = "CASE WHEN d % 3 <> 0 AND d % 2 = 0 THEN 0 ELSE 1 END", "CASE WHEN d % 3 = 0 THEN 2 ELSE 1 END"
BOUNDS = [
    (28, "WS-N", "true", "9", "9"), (29, "WS-N", "true", "9", "9"), (29, "WS-M", "true", "9", "9"), (30, "WS-I", "true", "1", "1"), (30, "WS-N", "true", "d % 12 - 5", "d % 12 - 5"), (31, "WS-A", "d % 2 = 0", "0", "0"),
    (32, "WS-A", "d % 2 = 0", "0", "0"), (34, "WS-A", "true", LOW, HIGH), (35, "WS-I", "true", "1", "1"), (39, "WS-I", "true", "1", "NULL"), (39, "WS-A", "true", LOW, "CASE WHEN d % 4 = 0 THEN 7 END"),
    (40, "WS-I", "true", "1", "3 + d % 9"), (40, "WS-E", "true", "0", "0"), (40, "WS-A", "true", LOW, "CASE WHEN d % 4 = 0 THEN 7 END"), (42, "WS-I", "true", "4 + d % 9", "NULL"), (44, "WS-I", "true", "4 + d % 9", "NULL"),
    (51, "WS-A", "true", LOW, f"CASE WHEN d % 4 = 0 THEN {HIGH} END"), (51, "WS-I", "d % 12 = 0", "1", "1"), (62, "WS-A", "true", f"CASE WHEN d % 4 = 0 THEN {LOW} ELSE 7 END", "7"),
]


def chosen(column: int) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {b[column]}" for k, b in enumerate(BOUNDS)) + " END"


@query(rows_of(f"SELECT d AS program, stmt::BIGINT AS node, name, ({chosen(3)})::BIGINT AS low, ({chosen(4)})::BIGINT AS high FROM s JOIN r USING (n) WHERE {chosen(2)}", [f"({b[0]}, '{b[1]}', {k})" for k, b in enumerate(BOUNDS)], "n, name, k"))
def cobol_intervals(spark, d):
    f = program_rules.facts(*sources(spark, d))
    return intervals.intervals(f.edges, f.stmts, f.procedures, f.items, f.operands)


#: Lines of programs whose paths matter, written as those above.
PATHS: list[tuple[int, str, str]] = [
    (n, c, "'       " + x.replace("'", "''") + "'") for n, c, x in (
        (1, "true", "IDENTIFICATION DIVISION."), (2, "true", "PROGRAM-ID. PATHS."), (3, "true", "ENVIRONMENT DIVISION."), (4, "true", "INPUT-OUTPUT SECTION."), (5, "true", "FILE-CONTROL."),
        (6, "true", "    SELECT F1 ASSIGN TO DD1 FILE STATUS IS FS1."), (7, "true", "DATA DIVISION."), (8, "true", "FILE SECTION."), (9, "true", "FD F1."), (10, "true", "01 R1 PIC X."),
        (11, "true", "WORKING-STORAGE SECTION."), (13, "true", "01 FS1 PIC XX."), (14, "true", "01 SW PIC X."), (15, "true", "   88 DONE VALUE 'Y'."),
        (16, "true", "    EXEC SQL DECLARE C1 CURSOR FOR SELECT A FROM T END-EXEC."), (20, "true", "PROCEDURE DIVISION."), (21, "true", "A-SECT SECTION."), (22, "true", "P-1."), (30, "true", "    READ F1"),
        (31, "d % 2 = 0", "    IF FS1 = '00' CONTINUE END-IF"), (32, "true", "    WRITE R1"), (33, "true", "    IF FS1 = '00' CONTINUE END-IF"), (34, "true", "    PERFORM P-2 UNTIL DONE"),
        (35, "d % 5 <> 0", "    EXEC SQL OPEN C1 END-EXEC"), (36, "d % 5 <> 0", "    EXEC SQL FETCH C1 INTO :SW END-EXEC"), (37, "d % 7 = 0", "    IF SQLCODE = 100 CONTINUE END-IF"),
        (38, "d % 5 = 1", "    EXEC SQL OPEN C1 END-EXEC"), (39, "d % 5 IN (2, 3)", "    EXEC SQL CLOSE C1 END-EXEC"), (40, "true", "    CALL 'SUB1'"), (41, "d % 11 = 0", "    IF RETURN-CODE > 0 CONTINUE END-IF"),
        (42, "d % 11 <> 0", "    DISPLAY RETURN-CODE"), (43, "true", "    GO TO P-9."), (60, "true", "P-2."), (61, "d % 3 = 0", "    MOVE 'Y' TO SW."), (62, "d % 3 <> 0", "    CONTINUE."), (63, "d % 4 = 0", "    EXIT."),
        (70, "true", "B-SECT SECTION."), (71, "true", "P-9."), (72, "true", "    STOP RUN."),
    )
]
PATH_FINDINGS = [
    ("R012", 34, "DONE", "d % 3 <> 0"), ("R014", 61, "A-SECT", "d % 4 <> 0"), ("R014", 62, "A-SECT", "d % 4 <> 0"), ("R017", 30, "READ F1", "d % 2 = 1"), ("R018", 36, "FETCH", "d % 7 <> 0"),
    ("R019", 35, "C1", "d % 5 IN (1, 4)"), ("R029", 40, "SUB1", "d % 11 <> 0"), ("R055", 16, "C1:never opened", "d % 5 = 0"), ("R055", 38, "C1:second open", "true"),
]


@query(findings_sql(PATH_FINDINGS, PATHS))
def cobol_path_findings(spark, d):
    return path_rules.path_rules(program_rules.facts(programs(spark, d, PATHS), "doc_id", "text"))
