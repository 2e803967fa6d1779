"""Easytrieve text to statements, macros, fields, uses of files and findings."""

import pytest

from punchdeck.operators import easytrieve as ops
from punchdeck.sources import easytrieve

SOURCE = """* a comment
PARM LINK(DEMO) USERID('ME' 'SECRET')
FILE SALES FB(100 1000)
 S-ID 1 5 N . S-AMT * 7 N 2.  * amounts
 S-DATE * +2 8 A
 S-YEAR S-DATE 4 A
 S-MON S-YEAR +4 2 N
 S-ALL 90 6 A OCCURS 2
FILE RATES TABLE
 ARG 1 2 A
 DESC 4 5 A
FILE CODES TABLE INSTREAM
 ARG 1 2 A
 DESC 4 5 A
01 GET NOT A STATEMENT
02 IF
ENDTABLE
FILE OUT VS PASSWORD 'X''Y'
COPY SALES
FILE LIST PRINTER
MSTART OWN
MACRO 1 F KEY OUT
 GET &F. .
 PUT &KEY
MEND
W-TOTAL W 7 P 2 VALUE 0
SORT SALES TO OUT USING (S-ID) BEFORE SCREENED
JOB NAME FIRST FINISH DONE
 W-TOTAL = W-TOTAL + +
   SALES:S-AMT - S-ID
 IF S-ID NOT NUMERIC
   DISPLAY LIST 'BAD. ' S-ID-5
 END-IF
 %OWN SALES KEY LIST
 DO WHILE NOT EOF SALES
   GET SALES
 END-DO
 SQL UPDATE T SET A = 1 +
   WHERE B = 'x  y'
 PERFORM HELP
 CALL SUBPGM USING (W-TOTAL)
HELP. PROC
 SQL COMMIT
 IF SQLCODE NE 0
  STOP
 END-IF
END-PROC
SPARE. PROC
 %NOWHERE A
END-PROC
REPORT R1 PRINTER LIST
 LINE S-ID
 BEFORE-LINE. PROC
  S-ID = 1
 END-PROC
JOB INPUT NULL
 LINK W-TOTAL
 %LOOP
JOB INPUT (SALES KEY (S-ID) OUT KEY S-ID)
 STOP
"""
LOOP = "* again\nMACRO\n%LOOP\n DISPLAY 'L'\n"


@pytest.fixture(scope="module")
def read(spark):
    sources = spark.createDataFrame([("DEMO", "a/demo.ezt", SOURCE), ("EMPTY", "a/empty.ezt", ""), ("NONE", None, None)], "program string, path string, text string")
    members = spark.createDataFrame([("a/loop.mac", LOOP), ("b/LOOP.mac", "PUT OTHER"), ("b/null.mac", None)], "path string, text string")
    rows, macros = easytrieve.expanded(sources, "program", "text", easytrieve.library(members, "path", "text"), "path")
    rows = easytrieve.placed(rows)
    return rows.cache(), macros.cache()


def at(read, line):
    return [" ".join(r["words"]) for r in read[0].filter(f"file is null and line = {line}").orderBy("n").collect()]


def test_statements(read):
    assert at(read, 4) == ["S-ID 1 5 N", "S-AMT * 7 N 2"]
    assert at(read, 5) == ["S-DATE * +2 8 A"]
    assert at(read, 15) == at(read, 16) == []
    assert at(read, 29) == ["W-TOTAL = W-TOTAL + SALES:S-AMT - S-ID"]
    assert at(read, 32) == ["DISPLAY LIST 'BAD. ' S-ID-5"]
    sql = read[0].filter("line = 38").first()
    assert (sql["text"], sql["end_line"]) == ("SQL UPDATE T SET A = 1 WHERE B = 'x  y'", 39)
    assert {r["program"] for r in read[0].collect()} == {"DEMO"}


def test_macros(read):
    rows, macros = read
    own = [" ".join(r["words"]) for r in rows.filter("activity = 2 and proc_n = 0 and line in (23, 24)").orderBy("n").collect()]
    assert own == ["GET SALES", "PUT LIST"]
    assert [(r["line"], r["file"]) for r in rows.filter("get(words, 1) = \"'L'\"").collect()] == [(4, "a/loop.mac")]
    assert {(r["name"], r["line"], r["found"]) for r in macros.collect()} == {("OWN", 34, True), ("NOWHERE", 49, False), ("LOOP", 58, True), ("LOOP", 3, False)}


def test_places(read):
    roles = {(r["line"], r["role"], r["activity"], r["proc"]) for r in read[0].filter("role in ('activity', 'proc', 'report')").collect()}
    assert roles == {(27, "activity", 1, None), (28, "activity", 2, None), (42, "proc", 2, "HELP"), (48, "proc", 2, "SPARE"), (51, "report", 2, None), (53, "proc", 2, "BEFORE-LINE"), (56, "activity", 3, None), (59, "activity", 4, None)}
    assert {r["depth"] for r in read[0].filter("line in (31, 33)").collect()} == {0} and read[0].filter("line = 32").first()["depth"] == 1
    acts = {r["activity"]: (r["kind"], r["name"], r["inputs"], r["sorted_to"]) for r in ops.activities(read[0]).collect()}
    assert acts == {1: ("SORT", None, ["SALES"], "OUT"), 2: ("JOB", "FIRST", [], None), 3: ("JOB", None, ["NULL"], None), 4: ("JOB", None, ["SALES", "OUT"], None)}


def test_fields_and_uses(read):
    held = ops.files(read[0])
    assert {(r["file"], r["organisation"], r["format"], r["record_length"], r["is_table"], r["instream"]) for r in held.collect()} == {
        ("SALES", "SEQUENTIAL", "FB", 100, False, False), ("RATES", "SEQUENTIAL", None, None, True, False), ("CODES", "SEQUENTIAL", None, None, True, True), ("OUT", "VSAM", None, None, False, False), ("LIST", "PRINTER", None, None, False, False)}
    found = {(r["file"], r["name"]): (r["start"], r["last"]) for r in ops.fields(read[0]).collect()}
    sales = {"S-ID": (1, 5), "S-AMT": (6, 12), "S-DATE": (15, 22), "S-YEAR": (15, 18), "S-MON": (19, 20), "S-ALL": (90, 101)}
    assert {k[1]: v for k, v in found.items() if k[0] == "SALES"} == sales == {k[1]: v for k, v in found.items() if k[0] == "OUT"}
    assert found[(None, "W-TOTAL")] == (None, None)
    uses = {r["file"]: r["access"] for r in ops.file_uses(read[0], held).collect()}
    assert uses == {"SALES": "READ", "OUT": "UPDATE", "LIST": "WRITE", "RATES": "READ"}
    assert {(r["verb"], r["target"], r["literal"]) for r in ops.calls(read[0]).collect()} == {("CALL", "SUBPGM", True), ("LINK", "W-TOTAL", False)}


def test_findings(read):
    rows, macros = read
    found = {(r["line"], r["rule_id"], r["subject"]) for r in ops.findings(rows, macros).collect()}
    assert found == {
        (2, "R103", "USERID"), (18, "R103", "OUT"), (8, "R098", "S-ALL"), (9, "R104", "RATES"), (23, "R101", "SALES"), (29, "R100", "S-AMT"), (38, "R102", "UPDATE"), (48, "R105", "SPARE"),
        (49, "R106", "NOWHERE"), (56, "R097", "JOB"), (3, "R106", "LOOP"),
    }


def test_steps_without_dds(spark, read):
    held = ops.files(read[0])
    steps = spark.createDataFrame([("J", "S1", "demo"), ("J", "S2", "DEMO"), ("J", "S3", "OTHER")], "job string, step string, program string")
    dds = spark.createDataFrame([("J", "S1", f) for f in ("SALES", "OUT", "RATES", "list")] + [("J", "S2", "OUT"), ("J", "S2", "RATES"), ("J", "S2", "LIST")], "job string, step string, dd string")
    assert [(r["file"], r["job"], r["step"]) for r in ops.unallocated(held, ops.file_uses(read[0], held), steps, dds).collect()] == [("SALES", "J", "S2")]


def test_without_macros(spark):
    rows, macros = easytrieve.expanded(spark.createDataFrame([(1, "JOB INPUT A")], "id int, text string"), "id", "text")
    assert macros.isEmpty() and easytrieve.placed(rows).first()["role"] == "activity"
