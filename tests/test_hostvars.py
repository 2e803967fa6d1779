"""Host variables against declared columns; functions over columns on either side of a comparison."""

from punchdeck.operators import hostvars, sqlscope
from punchdeck.sources import cobol

SOURCE = """       IDENTIFICATION DIVISION.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  H-ROW.
           05  H-A PIC S9(9) BINARY.
           05  H-B PIC X(3).
       77  H-T PIC X(10).
       77  H-ED PIC ZZ9.
           EXEC SQL DECLARE T TABLE (A INT, B CHAR(3) NOT NULL,
             C TIMESTAMP NOT NULL, V VARCHAR(9)) END-EXEC.
           EXEC SQL DECLARE S.T TABLE (A SMALLINT) END-EXEC.
       PROCEDURE DIVISION.
           EXEC SQL SELECT * INTO :H-ROW FROM S.T END-EXEC
           EXEC SQL SELECT A, B INTO :H-A FROM T END-EXEC
           EXEC SQL SELECT MAX(A), B, (SELECT C FROM T)
             INTO :H-ED, :H-T, :H-B FROM T WHERE A IN (1, 2) END-EXEC
           EXEC SQL SELECT A INTO :H-A FROM UNKNOWN END-EXEC
           EXEC SQL FETCH NEXT FROM C9 INTO :H-A END-EXEC
           EXEC SQL INSERT INTO T (A, C, V)
             VALUES (:H-ED, :H-T, TRIM(:H-T)) END-EXEC
           EXEC SQL INSERT INTO T SELECT * FROM T END-EXEC
           EXEC SQL UPDATE T SET (A, B) = (1, 2) END-EXEC
           GOBACK.
"""


def read(spark, *texts):
    sources = spark.createDataFrame([(f"P{k}", text) for k, text in enumerate(texts)], "id string, text string")
    tokens = cobol.tokens(sources, "id", "text")
    held = hostvars.blocks(tokens)
    return tokens, held, hostvars.declared(held)


def test_pairs(spark):
    _, held, cols = read(spark, SOURCE, "", None)
    assert {(r["table"], r["name"], r["type"], r["length"], r["nullable"]) for r in cols.collect()} == {("T", "A", "INT", 0, True), ("T", "B", "CHAR", 3, False), ("T", "C", "TIMESTAMP", 0, False), ("T", "V", "VARCHAR", 9, True)}
    lines = held.select("stmt", "line")
    reads = {(r["line"], r["name"], r["host"]) for r in hostvars.read_pairs(held, cols).join(lines, "stmt").collect()}
    assert reads == {(13, c, "H-ROW") for c in "ABCV"} | {(15, "B", "H-T")}
    writes = {(r["line"], r["name"], r["host"], r["indicator"]) for r in hostvars.write_pairs(held, cols).join(lines, "stmt").collect()}
    assert writes == {(19, "A", "H-ED", None), (19, "C", "H-T", None)}


def test_rules(spark):
    tokens, _, _ = read(spark, SOURCE)
    found = {(r["line"], r["rule_id"], r["subject"]) for r in hostvars.host_rules(tokens, cobol.data_items(tokens)).collect()}
    assert found == {(13, "R037", "A, V"), (16, "R038", "H-T"), (20, "R038", "H-ED")}


def test_functions_on_columns(spark):
    texts = [
        "SELECT 1 FROM T WHERE UPPER(A) = 'X'", "SELECT 1 FROM T WHERE 'X' = UPPER(A)", "SELECT 1 FROM T JOIN U ON T.A = CAST(U.B AS CHAR(3))", "SELECT 1 FROM T WHERE A = UPPER('x')",
        "SELECT 1 FROM T WHERE UPPER(A) LIKE 'X'", "SELECT UPPER(A) FROM T WHERE (B = 1 OR (SUBSTR(A, 1, 2) = 'AB'))",
    ]
    rows = sqlscope.tokens(spark.createDataFrame(list(enumerate(texts)), "stmt int, text string"))
    assert sorted((r["stmt"], r["side"]) for r in sqlscope.function_on_column(rows).collect()) == [(0, "left"), (1, "right"), (2, "right"), (5, "left")]
