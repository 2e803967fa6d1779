"""COBOL text to statements, flow, operands and findings; SQL scripts to statements and scopes."""

import pytest

from punchdeck.operators import flow, intervals, operands, path_rules, program_rules, sqlscope
from punchdeck.sources import cobol, scripts

DEMO = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. DEMO.
      * a comment with MOVE
       DATA DIVISION.
       FILE SECTION.
       FD  INFILE RECORDING MODE F.
       01  IN-REC PIC X(80).
       WORKING-STORAGE SECTION.
       01  WS-GROUP.
           05  WS-A         PIC S9(5)V99 COMP-3 VALUE ZERO.
           05  WS-TAB OCCURS 1 TO 10 TIMES DEPENDING ON WS-N.
               10 WS-E PIC 9(4) USAGE IS BINARY.
           05  FILLER PIC ZZ,ZZ9.99.
           05  WS-X REDEFINES WS-A PIC X(4).
           88  OK VALUES ARE 1 2 3.
       77  WS-N PIC 99 VALUE 5.
       77  WS-LON PIC X(80) VALUE "this is a long literal that goes on a
      -    "nd on".
       LINKAGE SECTION.
       01  L-A PIC X.
       PROCEDURE DIVISION USING L-A.
       MAIN SECTION.
       START-UP.
           OPEN INPUT INFILE
           READ INFILE AT END MOVE 'Y' TO WS-X NOT AT END
              ADD 1 TO WS-N END-READ
           IF WS-N > 1 AND WS-A = "."
              IF WS-N = 2 DISPLAY "TWO" ELSE NEXT SENTENCE
           ELSE
              PERFORM VARYING WS-N FROM 1 BY 1 UNTIL WS-N > 10
                 MOVE WS-E(WS-N) TO WS-A *> inline
                 EXIT PERFORM
              END-PERFORM
           END-IF.
           EVALUATE WS-N
             WHEN 1
             WHEN 2 PERFORM PARA-A THRU PARA-B 5 TIMES
             WHEN OTHER CONTINUE
           END-EVALUATE
           EXEC SQL SELECT A INTO :WS-A
              FROM T WHERE X = 'END' END-EXEC
           PERFORM PARA-A UNTIL WS-N = 3.
           GO TO PARA-A PARA-B DEPENDING ON WS-N.
       PARA-A.
           COMPUTE WS-A = WS-N * -2 ON SIZE ERROR GO TO PARA-B
             END-COMPUTE.
       PARA-B. STOP RUN.
"""


@pytest.fixture(scope="module")
def demo(spark):
    return program_rules.facts(spark.createDataFrame([(1, DEMO), (2, None), (3, ""), (4, "no COBOL at all")], "id int, text string"), "id", "text")


def test_data_items(demo):
    found = {r.idx: r for r in demo.items.collect()}
    assert [found[i].name for i in sorted(found)] == ["IN-REC", "WS-GROUP", "WS-A", "WS-TAB", "WS-E", "FILLER", "WS-X", "OK", "WS-N", "WS-LON", "L-A"]
    assert (found[3].picture, found[3].usage, found[3].value, found[3].line) == ("S9(5)V99", "COMP-3", "ZERO", 10) and found[4].occurs == 10 and found[5].usage == "COMP"
    assert found[6].picture == "ZZ,ZZ9.99" and found[7].redefines == "WS-A" and found[8].level == 88 and found[10].value == '"this is a long literal that goes on and on"' and found[11].section == "LINKAGE"


def test_statements(demo):
    rows = {r.stmt: r for r in demo.stmts.collect()}
    assert [(rows[i].verb, rows[i].parent, rows[i].branch, rows[i].line) for i in sorted(rows)] == [
        ("OPEN", 0, None, 24), ("READ", 0, None, 25), ("MOVE", 2, "END", 25), ("ADD", 2, "NOT END", 26), ("IF", 0, None, 27), ("IF", 5, "THEN", 28), ("DISPLAY", 6, "THEN", 28), ("NEXT", 6, "ELSE", 28),
        ("PERFORM", 5, "ELSE", 30), ("MOVE", 9, "BODY", 31), ("EXIT", 9, "BODY", 32), ("EVALUATE", 0, None, 35), ("PERFORM", 12, "WHEN 1", 37), ("CONTINUE", 12, "WHEN OTHER", 38), ("EXEC SQL", 0, None, 40),
        ("PERFORM", 0, None, 42), ("GO", 0, None, 43), ("COMPUTE", 0, None, 45), ("GO", 18, "SIZE", 45), ("STOP", 0, None, 47),
    ]
    assert rows[3].text == "MOVE 'Y' TO WS-X" and rows[5].last == 11 and rows[9].loop == "until" and rows[12].branches == ["WHEN 1", "WHEN OTHER"]


def test_flow(demo):
    found = {(r.from_node, r.to_node) for r in demo.edges.filter("program = 1").collect()}
    assert found == {
        (0, 1), (1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6), (5, 9), (6, 7), (6, 8), (7, 12), (8, 12), (9, 10), (9, 12), (10, 11), (11, 9), (12, 13), (12, 14), (13, 15), (13, 18), (14, 15), (15, 16),
        (16, 17), (16, 18), (17, 18), (17, 20), (18, 16), (18, 17), (18, 19), (18, 20), (19, 20), (20, -1),
    }


def test_operands(demo):
    found = {(r.node, r.name, r.defined, r.used) for r in demo.operands.collect()}
    assert {(3, "WS-X", True, False), (4, "WS-N", True, True), (9, "WS-N", True, False), (10, "WS-E", False, True), (10, "WS-N", False, True), (15, "WS-A", True, False), (17, "WS-N", False, True), (18, "WS-A", True, False)} <= found
    assert not {n for _, n, _, _ in found} - {"WS-X", "WS-N", "WS-A", "WS-E"}


def procedure(spark, *lines, data=()):
    text = "\n".join(["       DATA DIVISION.", "       WORKING-STORAGE SECTION.", *(f"       {x}" for x in data), "       PROCEDURE DIVISION.", *(f"       {x}" if x.startswith("P-") else f"           {x}" for x in lines)])
    return program_rules.facts(spark.createDataFrame([("X", text)], "id string, text string"), "id", "text")


def test_roles(spark):
    f = procedure(spark, "P-1.", "SET I UP BY J", "DIVIDE A INTO B GIVING C REMAINDER D", "SUBTRACT A B FROM C", "STRING A DELIMITED BY SPACE B INTO C WITH POINTER D", "CALL 'X' USING A RETURNING B",
                  "PERFORM P-2 N TIMES", "MOVE A OF G TO T(I J) U", "COMPUTE A ROUNDED = FUNCTION MAX(B C) + D", "ACCEPT A FROM DATE", "READ F INTO R KEY IS K.", "P-2.", "EXEC CICS RECEIVE MAP('M') INTO(Z) RESP(W) END-EXEC.")
    got = {}
    for r in f.operands.collect():
        got.setdefault(r.node, set()).add(r.name + ("D" if r.defined else "") + ("U" if r.used else ""))
    assert got == {
        1: {"ID", "JU"}, 2: {"AU", "BU", "CD", "DD"}, 3: {"AU", "BU", "CDU"}, 4: {"AU", "BU", "CD", "DDU"}, 5: {"AU", "BD"}, 6: {"NU"}, 7: {"AU", "TD", "IU", "JU", "UD"}, 8: {"AD", "BU", "CU", "DU"}, 9: {"AD"},
        10: {"RD", "KU"}, 11: {"ZD", "WD"},
    }
    assert {(r.node, r.name) for r in operands.external_inputs(f.stmts).collect()} == {(9, "A"), (11, "Z")}


def test_intervals(spark):
    f = procedure(spark, "P-1.", "MOVE 5 TO A", "IF B = 1 ADD 3 TO A END-IF", "SUBTRACT 10 FROM A GIVING C", "PERFORM UNTIL A >= 20", "ADD 1 TO A", "END-PERFORM", "COMPUTE C = (A - 2) * -3", "CONTINUE", "PERFORM P-2 VARYING I FROM 2 BY 2 UNTIL I > 9",
                  "MOVE I TO C.", "GOBACK.", "P-2.", "MOVE T(I) TO C.", data=("77 A PIC 9(3).", "77 B PIC 9 VALUE 1.", "77 C PIC S9(4).", "77 I PIC 99.", "01 G.", " 05 T PIC 9 OCCURS 9."))
    found = {(r.node, r.name): (r.low, r.high) for r in intervals.intervals(f.edges, f.stmts, f.procedures, f.items, f.operands).collect()}
    assert found[3, "A"] == (5, 5) and found[4, "A"] == (5, 8) and found[5, "C"] == (-5, -2) and found[6, "A"] == (5, 19) and found[7, "A"] == (20, None)
    assert found[8, "C"] == (None, -54) and found[12, "I"] == (2, 9) and found[10, "I"] == (2, None)


def test_long_paths(spark):
    """Chains of 300 statements in 40 programs, and a taint path of 100 moves: nothing is bounded."""
    edges = spark.range(40 * 300).selectExpr("id div 300 AS program", "id % 300 AS from_node", "id % 300 + 1 AS to_node")
    assert flow.reachable(edges, edges.filter("from_node = 0").selectExpr("program", "from_node AS node")).groupBy("program").count().filter("count <> 301").isEmpty()
    moves = spark.range(1, 101).selectExpr("0L AS program", "id AS node", "concat('V', id - 1) AS source", "concat('V', id) AS name")
    sources = spark.createDataFrame([(0, 0, "V0")], "program long, node long, name string")
    taint = flow.tainted(edges, sources, moves, moves.select("program", "node", "name"))
    path = flow.taint_steps(taint, moves, sources, spark.createDataFrame([(0, 150, "V100")], "program long, node long, name string")).first().path
    assert path == [*range(101), 150]
    far = flow.first_met(edges.filter("program = 0"), sources.select("program", "node"), spark.createDataFrame([(0, 299)], "program long, node long")).first()
    assert (far.start, far.node, far.hops) == (0, 299, 299)


SCRIPT = """-- banner; with semicolon
CREATE TABLE T (A INT); /* x; */ INSERT INTO T VALUES ('a;b', "q;");
SELECT CASE WHEN A = 1 THEN 2 END FROM T -- tail
;
--#SET TERMINATOR @
CREATE PROCEDURE S.P1 (IN X INT)
P1: BEGIN NOT ATOMIC
  DECLARE V, W INT;
  IF X > 1 THEN SET V = CASE WHEN X = 2 THEN 1 ELSE 0 END; END IF;
  BEGIN
    UPDATE T SET A = V;
  END;
  FOR R AS SELECT A FROM T DO SET V = V + 1; END FOR;
END P1@
TERMINATOR ;
UPDATE T SET A = 1
"""


def test_scripts(spark):
    cards = "\n".join(x.ljust(72) + f"{i:08d}" for i, x in enumerate(["SELECT A", "  FROM T;", "COMMIT;"]))
    rows = spark.createDataFrame([(1, SCRIPT), (2, None), (3, ""), (4, cards), (5, "SELECT 'abc\n FROM T; X;")], "id int, text string")
    found = {(r.script, r.nth): (r.line, r.col, r.end_line, r.end_col) for r in scripts.statements(rows, "id", "text").collect()}
    assert found == {
        (1, 1): (2, 1, 2, 22), (1, 2): (2, 34, 2, 67), (1, 3): (3, 1, 3, 40), (1, 4): (6, 1, 14, 6), (1, 5): (16, 1, 16, 18), (4, 1): (1, 1, 2, 8), (4, 2): (3, 1, 3, 6), (5, 1): (1, 1, 2, 11),
    }
    inner = scripts.nested(rows.filter("id = 1"), "id", "text")
    got = {tuple(r.path): r.text for r in inner.collect()}
    assert got[4, 1] == "DECLARE V, W INT" and got[4, 4, 1] == "UPDATE T SET A = V" and got[4, 3] == "END IF" and got[4, 6] == "END FOR" and len(got) == 12
    assert [(r.kind, r.name, r.line, r.n_statements) for r in scripts.routines(inner).collect()] == [("PROCEDURE", "S.P1", 6, 7)]
    assert {r.name for r in scripts.variables(inner).collect()} == {"X", "V", "W"}
    assert [(r.script, r.line) for r in scripts.unclosed_literals(rows, "id", "text").collect()] == [(5, 1)]


def test_scopes(spark):
    stmts = spark.createDataFrame([
        (1, "CREATE TABLE S.T (A INT NOT NULL, B CHAR(10), C DECIMAL(5, 2), PRIMARY KEY (A))"), (2, "DECLARE U TABLE (X INT, Y INT)"),
        (3, "SELECT T.A, B AS BB, COALESCE(Z, C) FROM S.T T WHERE UPPER(B) = 'X' AND A + 1 > :HV AND (C LIKE '%z' OR C = 1)"), (4, "SELECT * FROM U WHERE EXISTS (SELECT * FROM S.T WHERE A = U.X AND Q = Y)"),
        (5, "SELECT A FROM S.T UNION ALL SELECT * FROM U ORDER BY 1"), (6, "WITH W AS (SELECT A AS K FROM S.T) SELECT W.K, W.NO FROM W, U"),
        (7, "UPDATE S.T SET B = (SELECT MAX(Y) FROM U WHERE X = A), D = 1 WHERE C BETWEEN 1 AND 2"), (8, "SELECT COUNT(*) FROM S.T A, U B"), (9, "INSERT INTO U (X, Y) SELECT A, NOPE FROM S.T"), (10, "DELETE FROM U WHERE SUBSTR(X, 1, 2) <> 'a'"),
    ], "stmt int, text string")
    t = sqlscope.tokens(stmts.filter("stmt > 2")).cache()
    assert {(r.stmt, r.places) for r in sqlscope.undeclared_columns(stmts).collect()} == {(3, "T.Z"), (4, "?.Q"), (7, "T.D"), (9, "T.NOPE")}
    assert {r.stmt for r in sqlscope.select_star(t).collect()} == {4, 5} and {r.stmt for r in sqlscope.unjoined(t).collect()} == {6, 8}
    assert {(r.stmt, r.reason) for r in sqlscope.non_sargable(t).collect()} == {(3, "function"), (3, "arithmetic"), (3, "pattern"), (10, "function")}
    found = {(r.stmt, r.name): r.table for r in sqlscope.resolved(sqlscope.columns(t), sqlscope.levels(t), sqlscope.with_declarations(sqlscope.sources(t), sqlscope.declared(stmts))).collect()}
    assert found[4, "Y"] == "U" and found[4, "A"] == "S.T" and found[7, "Y"] == "U" and found[7, "B"] == "S.T" and found[6, "K"] is None


ORDERED = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. X.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT F1 ASSIGN TO DD1 FILE STATUS IS FS1.
           SELECT F2 ASSIGN DD2 STATUS FS2.
       DATA DIVISION.
       FILE SECTION.
       FD F1.
       01 R1 PIC X.
       FD F2.
       01 R2 PIC X.
       WORKING-STORAGE SECTION.
       01 FS1 PIC XX.
       01 FS2 PIC XX.
          88 FS2-OK VALUE '00'.
       01 SW PIC X.
          88 DONE VALUE 'Y'.
       EXEC SQL DECLARE C1 CURSOR FOR SELECT A FROM T END-EXEC.
       EXEC SQL DECLARE C2 CURSOR FOR SELECT A FROM T END-EXEC.
       PROCEDURE DIVISION.
       A-SECT SECTION.
       P-1.
           READ F1
           READ F1
           IF FS1 = '00' DISPLAY SW.
           WRITE R2
           IF FS2-OK CONTINUE.
           PERFORM P-2 UNTIL DONE.
           PERFORM P-3 UNTIL DONE.
           EXEC SQL OPEN C1 END-EXEC
           EXEC SQL FETCH C1 INTO :SW END-EXEC
           IF SQLCODE = 100 CONTINUE.
           EXEC SQL OPEN C1 END-EXEC
           EXEC SQL UPDATE T SET A = 1 END-EXEC.
           EXEC SQL ROLLBACK END-EXEC.
           EXEC SQL FETCH C1 INTO :SW END-EXEC
           CALL 'SUB1'
           CALL 'SUB2' IF RETURN-CODE > 0 CONTINUE.
       P-2. PERFORM P-4.
       P-3. CONTINUE.
       P-4. MOVE 'Y' TO SW.
       B-SECT SECTION.
       P-5. STOP RUN.
"""


def test_path_rules(spark):
    f = program_rules.facts(spark.createDataFrame([(1, ORDERED), (2, "")], "id int, text string"), "id", "text")
    found = {(r.program, r.rule_id, r.line, r.subject) for r in path_rules.path_rules(f).collect()}
    assert found == {
        (1, "R012", 31, "DONE"), (1, "R014", 43, "A-SECT"), (1, "R017", 25, "READ F1"), (1, "R018", 36, "UPDATE"), (1, "R018", 38, "FETCH"), (1, "R019", 32, "C1"), (1, "R029", 39, "SUB1"),
        (1, "R055", 21, "C2:never opened"), (1, "R055", 35, "C1:second open"), (1, "R055", 38, "C1:fetch after rollback"),
    }
