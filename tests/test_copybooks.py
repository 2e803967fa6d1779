"""Copybooks by search folders and extensions; Easytrieve under a step."""

from punchdeck.sources import copybooks, easytrieve, jcl


def test_search(spark):
    files = spark.createDataFrame([(p,) for p in ("a/X.cpy", "a/X", "b/Y.COPY", "a/Y.copy", "a/deep/Z.cpy", "a\\W.CPY", "a/v.cpy", "Q.cpy", None, "a/.cpy")], "path string")
    folders = spark.createDataFrame([("b/", 0), ("a", 1), ("a", 2), ("", 3), (None, 4)], "folder string, rank int")
    uses = spark.createDataFrame([(k, n) for k, n in enumerate(("X", "Y", "Z", "W", "V", "X.cpy", "Q", None))], "id int, name string")
    found = {r["name"]: r["path"] for r in copybooks.resolved(uses, copybooks.called(files, folders)).collect()}
    assert found == {"X": "a/X", "Y": "b/Y.COPY", "Z": None, "W": "a\\W.CPY", "V": None, "X.cpy": "a/X.cpy", "Q": "Q.cpy", None: None}
    assert copybooks.called(files.limit(0), folders).isEmpty()


def test_under_steps(spark):
    job = "//J JOB\n//A EXEC PGM=EZTPA00\n//SYSIN DD *\nJOB INPUT X\n/*\n//B EXEC PGM=EZTPA00\n//SYSIN DD DSN=S\n//C EXEC PGM=SORT\n//SYSIN DD *\n SORT\n/*\n"
    _, steps, dds = jcl.facts(jcl.parse(spark.createDataFrame([("f", job), ("g", None)], "path string, text string")))
    found = [tuple(r) for r in easytrieve.under_steps(steps, dds).collect()]
    assert found == [("f:J.A", "f", "J", "A", 3, "JOB INPUT X")]
