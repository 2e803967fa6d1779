"""Queries over host variables of COBOL programs, one for each document: its id chooses PICTUREs, nulls and indicators."""

from __future__ import annotations

from punchdeck.operators import hostvars
from punchdeck.operators.graph import cut
from punchdeck.plans.analogues import Query
from punchdeck.plans.programs import programs
from punchdeck.sources import cobol

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LINES: list[tuple[int, str, str]] = [
    (1, "true", "'       IDENTIFICATION DIVISION.'"), (2, "true", "concat('       PROGRAM-ID. P', d, '.')"), (3, "true", "'       DATA DIVISION.'"), (4, "true", "'       WORKING-STORAGE SECTION.'"),
    (5, "true", "concat('       01  H-ID PIC S9(', CASE WHEN d % 3 = 0 THEN 4 ELSE 9 END, ') COMP.')"), (6, "true", "concat('       01  H-NAME PIC X(', 10 + d % 2, ').')"), (7, "true", "'       01  H-QTY PIC S999V99 COMP-3.'"),
    (8, "true", "concat('       01  I-QTY PIC S9(4)', CASE WHEN d % 4 = 0 THEN '' ELSE ' COMP' END, '.')"), (9, "true", "'           EXEC SQL DECLARE S.ITEM TABLE'"),
    (10, "true", "concat('             (ID INTEGER NOT NULL, NAME CHAR(10)', CASE WHEN d % 5 = 0 THEN '' ELSE ' NOT NULL' END, ',')"), (11, "true", "'              QTY DECIMAL(5, 2)) END-EXEC.'"), (12, "true", "'      * EXEC SQL'"),
    (20, "true", "'       PROCEDURE DIVISION.'"), (21, "true", "'       P-A.'"), (22, "true", "'           EXEC SQL SELECT ID, T.NAME, QTY'"), (23, "true", "'             INTO :H-ID,'"), (24, "true", "'               :H-NAME,'"),
    (25, "true", "concat('               :H-QTY', CASE WHEN d % 6 = 0 THEN '' ELSE ' INDICATOR :I-QTY' END)"), (26, "true", "'             FROM S.ITEM T WHERE ID = 1 END-EXEC'"),
    (27, "true", "'           EXEC SQL DECLARE C1 CURSOR FOR SELECT * FROM ITEM END-EXEC'"), (28, "true", "'           EXEC SQL FETCH C1 INTO :H-ID, :H-NAME, :H-QTY:I-QTY END-EXEC'"),
    (29, "true", "'           EXEC SQL UPDATE S.ITEM SET NAME = :H-NAME,'"), (30, "true", "'             QTY = QTY + :H-QTY WHERE ID = :H-ID END-EXEC'"),
    (31, "true", "'           EXEC SQL INSERT INTO ITEM (QTY, ID)'"), (32, "true", "'             VALUES (:H-QTY :I-QTY, :H-ID) END-EXEC'"), (33, "true", "'           GOBACK.'"),
]
#: Line ``n`` of ``LINES`` in the source: the comments stand behind the twelfth, and 13 to 19 are not there.
DOCS = "(SELECT doc_id AS d, 1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) - 7 AS more FROM documents)"


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


PAIRS = [
    (22, 0, "ID", "H-ID", "NULL"), (22, 1, "NAME", "H-NAME", "NULL"), (22, 2, "QTY", "H-QTY", "CASE WHEN d % 6 <> 0 THEN 'I-QTY' END"), (28, 0, "ID", "H-ID", "NULL"), (28, 1, "NAME", "H-NAME", "NULL"),
    (28, 2, "QTY", "H-QTY", "'I-QTY'"), (29, 0, "NAME", "H-NAME", "NULL"), (31, 0, "QTY", "H-QTY", "'I-QTY'"), (31, 1, "ID", "H-ID", "NULL"),
]


@query(" UNION ALL ".join(f"""SELECT d AS program, (more + {n})::INT AS line, {at} AS at, '{name}' AS name, '{host}' AS host, {indicator} AS indicator,
  {"false" if name == "ID" else "d % 5 = 0" if name == "NAME" else "true"} AS nullable FROM {DOCS}""" for n, at, name, host, indicator in PAIRS))  # fmt: skip
def host_pairs(spark, d):
    held = cut(hostvars.blocks(cobol.tokens(programs(spark, d, LINES), "doc_id", "text")))
    cols = hostvars.declared(held)
    rows = hostvars.read_pairs(held, cols).union(hostvars.write_pairs(held, cols))
    return rows.join(held, "stmt").select("program", "line", "at", "name", "host", "indicator", "nullable")


@query(f"""
SELECT d AS program, (more + CASE WHEN d % 5 = 0 THEN 24 ELSE 25 END)::INT AS line, 'R037' AS rule_id, concat_ws(', ', CASE WHEN d % 5 = 0 THEN 'NAME' END, CASE WHEN d % 6 = 0 THEN 'QTY' END) AS subject FROM {DOCS} WHERE d % 5 = 0 OR d % 6 = 0
UNION ALL SELECT d, (more + 28)::INT, 'R037', 'NAME' FROM {DOCS} WHERE d % 5 = 0
UNION ALL SELECT d, (more + 23)::INT, 'R038', 'H-ID' FROM {DOCS} WHERE d % 3 = 0
UNION ALL SELECT d, (more + 24)::INT, 'R038', 'H-NAME' FROM {DOCS} WHERE d % 2 = 1
UNION ALL SELECT d, (more + 25)::INT, 'R038', 'I-QTY' FROM {DOCS} WHERE d % 4 = 0 AND d % 6 <> 0
UNION ALL SELECT d, (more + 28)::INT, 'R038', CASE WHEN d % 3 = 0 THEN 'H-ID' WHEN d % 2 = 1 THEN 'H-NAME' ELSE 'I-QTY' END FROM {DOCS} WHERE d % 3 = 0 OR d % 2 = 1 OR d % 4 = 0
UNION ALL SELECT d, (more + 29)::INT, 'R038', 'H-NAME' FROM {DOCS} WHERE d % 2 = 1
UNION ALL SELECT d, (more + 32)::INT, 'R038', CASE WHEN d % 4 = 0 THEN 'I-QTY' ELSE 'H-ID' END FROM {DOCS} WHERE d % 3 = 0 OR d % 4 = 0""")
def host_findings(spark, d):
    tokens = cut(cobol.tokens(programs(spark, d, LINES), "doc_id", "text"))
    return hostvars.host_rules(tokens, cobol.data_items(tokens))
