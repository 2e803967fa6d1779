from pyspark.sql import functions as F

from punchdeck.sources import folder

COBOL = "000100 IDENTIFICATION DIVISION.\n000200 PROGRAM-ID. ACCT.\n"


def laid(root):
    made = {
        "src/acct.cbl": COBOL.encode(), "src/rec.cpy": b"       01  REC.\n           05  A PIC X.\n", "src/job.cbl": b"//N JOB (1)\n//S EXEC PGM=A\n",
        "src/notes.md": b"PROGRAM-ID", "build/x.cbl": COBOL.encode(), "src/bin.cbl": b"A\x00B", "src/sj.cob": "000100*注記\n".encode("cp932") + COBOL.encode(),
        "src/bad.cbl": COBOL.encode() + b"\xff\xff\n", "db/t.x": b"-- a note\nCREATE TABLE T (A INT);\n", "db/u.x": b"SET A\n", "ezt/e.x": b"FILE INF\nJOB INPUT INF\n",
        "ebc/e.cbl": "".join(line.ljust(80) for line in COBOL.split("\n")[:2]).encode("cp037"), "q": b"nothing", "bom.sql": b"\xef\xbb\xbfSELECT A FROM T;", "empty.jcl": b"",
    }
    for name, content in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)


def test_assets(spark, tmp_path):
    laid(tmp_path)
    own = spark.createDataFrame([("q", "UTF-8"), ("src/sj.cob", "Shift_JIS"), ("rec.cpy", "Shift_JIS")], "name string, code_page string")
    got = {r["path"]: r for r in folder.assets(spark, str(tmp_path), own).collect()}
    kinds = {p: (r["kind"], r["mismatch"], r["code_page"], r["readable"]) for p, r in got.items()}
    assert kinds == {
        "src/acct.cbl": ("COBOL", False, "UTF-8", True), "src/rec.cpy": ("COPYBOOK", False, "Shift_JIS", True), "src/job.cbl": ("JCL", True, "UTF-8", True),
        "src/sj.cob": ("COBOL", False, "Shift_JIS", True), "src/bad.cbl": ("COBOL", False, "Shift_JIS", False), "db/t.x": ("SQL", False, "UTF-8", True),
        "db/u.x": (None, False, "UTF-8", True), "ezt/e.x": ("EASYTRIEVE", False, "UTF-8", True), "ebc/e.cbl": ("COBOL", False, "IBM930", True),
        "q": (None, False, "UTF-8", True), "bom.sql": ("SQL", False, "UTF-8", True),
    }
    assert got["bom.sql"]["text"].startswith("SELECT") and "注" in got["src/sj.cob"]["text"] and got["src/bad.cbl"]["text"] is None
    assert "IDENTIFICATION DIVISION" in got["ebc/e.cbl"]["text"]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_transactions(spark):
    rows = spark.createDataFrame([("a.csv", "TRANSID,PROGRAM\nTR01,ACCT\nbad row,X\nTR02,one,two\r\ntr01,BILL\r\n"), ("b.csv", None)], "path string, text string")
    assert {tuple(r) for r in folder.transactions(rows).collect()} == {("TR01", "BILL")}
    assert rows.select(F.length("text")).count() == 2
