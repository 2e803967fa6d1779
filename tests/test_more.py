import json

from punchdeck.functions.picture import parse, picture
from punchdeck.operators import incremental
from punchdeck.sources import findings


def test_picture(spark):
    assert parse("S9(5)V99") == ("NUMERIC", True, 5, 2, 7)
    assert parse("X(10)") == ("ALPHANUMERIC", False, 0, 0, 10)
    assert parse("ZZ,ZZ9.99-") == ("NUMERIC_EDITED", True, 5, 2, 10)
    assert parse("A(3)") == ("ALPHABETIC", False, 0, 0, 3) and parse("XX/XX")[0] == "ALPHANUMERIC_EDITED"
    rows = spark.createDataFrame([("9(4)",), (None,)], "p string").select(picture("p").alias("x")).select("x.*").collect()
    assert (rows[0].int_digits, rows[1].category) == (4, None)


def test_sarif(spark, tmp_path):
    rows = [("R2", "error", "b\\x.jcl", 3, 'say "no"'), ("R1", "note", "a.jcl", 9, "m"), ("R1", "note", "a.jcl", 2, "m")]
    df = spark.createDataFrame(rows, "rule_id string, level string, file string, line int, message string")
    findings.write_sarif(df, f"{tmp_path}/log")
    text = "".join(p.read_text() for p in sorted((tmp_path / "log").glob("part-*")))
    assert [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in json.loads(text)["runs"][0]["results"]] == [2, 9, 3]
    back = {tuple(r) for r in findings.read_sarif(spark, f"{tmp_path}/log").collect()}
    assert back == {("R2", "error", "b/x.jcl", 3, 'say "no"'), ("R1", "note", "a.jcl", 9, "m"), ("R1", "note", "a.jcl", 2, "m")}


def test_incremental(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9")], "path string, content_hash string")
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "4")], "path string, content_hash string")
    edges = spark.createDataFrame([("a", "b", "COPY"), ("x", "b", "CALL")], "from_path string, to_path string, kind string")
    assert {r.path for r in incremental.targets(incremental.changed(now, stored), edges).collect()} == {"a", "b", "c"}
    assert [r.path for r in incremental.removed(now, stored).collect()] == ["d"]
    paths = spark.createDataFrame([("Src\\A.cbl",), ("src2/a",), ("SRC",)], "path string")
    assert {r.path for r in incremental.in_scope(paths, ["src/"]).collect()} == {"Src\\A.cbl", "SRC"}


def test_logical_lines_commareas_and_repeats(spark):
    from punchdeck.operators import findings as found
    from punchdeck.operators import layout, lines

    rows = lines.source_lines(spark.createDataFrame([("a", "000100* NOTE\n000200 MOVE A TO B.\n000300/\n")], "id string, text string"), "id", "text")
    assert [(r.line, r.text.rstrip()) for r in lines.logical_lines(rows).collect() if r.text] == [(2, "MOVE A TO B.")]
    passed = spark.createDataFrame([("A", "X", 10, 1), ("A", "Y", 20, 2), ("B", "Z", 1, 3)], "program string, callee string, size int, line int")
    taken = spark.createDataFrame([("X", 11), ("Y", 20)], "program string, size int")
    assert [(r.callee, r.received) for r in layout.too_short_commareas(passed, taken).collect()] == [("X", 11)]
    twice = spark.createDataFrame([("m", 1, "j1"), ("m", 1, "j2"), ("m", 2, "j1")], "member string, line int, job string")
    assert found.reported_once(twice, "member", "line").count() == 2
