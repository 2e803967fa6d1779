from punchdeck.operators import flow, path_rules, program_rules, rules
from punchdeck.sources import cobol, easytrieve, jcl, procs


def test_one_search_for_all_rules(spark, monkeypatch):
    """A program's edges are dealt out once, however many rules, files and cursors ask."""
    asked = []
    whole = flow.solve
    monkeypatch.setattr(flow, "solve", lambda *a, **k: asked.append(1) or whole(*a, **k))
    lines = ["PROCEDURE DIVISION.", "P-1.", "    PERFORM P-2 UNTIL SW = 1", "    CALL 'A'", "    DISPLAY RETURN-CODE", "    STOP RUN.", "P-2.", "    CONTINUE."]
    text = "\n".join("       " + x for x in lines)
    f = program_rules.facts(spark.createDataFrame([(1, text), (2, text.replace("CONTINUE", "MOVE 1 TO SW"))], "program long, text string"), "program", "text")
    found = {(r.program, r.line, r.rule_id, r.subject) for r in path_rules.path_rules(f).collect()}
    assert found == {(1, 3, "R012", "SW"), (1, 4, "R029", "A"), (2, 4, "R029", "A")}
    assert len(asked) == 1


def test_steps_without_dds(spark):
    """Steps alone need no DDs, and their rules look at a job's steps side by side, without joins of the steps with themselves."""
    text = "//J JOB\n//S1 EXEC P1\n//S2 EXEC PGM=A\n//  IF (S9.RC = 0) THEN\n//S3 EXEC PGM=A,COND=(0,LE,S1)\n//  ELSE\n//S4 EXEC PGM=A,COND=(0,LE)\n//  ENDIF"
    frame = lambda *rows: jcl.guarded(jcl.parse(spark.createDataFrame(rows, "path string, text string")))
    own, members = frame(("j", text), ("empty", "")), frame(("P1", "//P1 PROC\n//PA EXEC PGM=B\n//PB EXEC PGM=C\n//D DD DSN=X\n// PEND"))
    steps, dds = procs.expanded(own, members, with_dds=False)
    assert dds is None
    order = lambda x: sorted((r.file, r["at"], r.step, r.parameters.get("IF")) for r in x.collect())
    assert order(steps) == order(procs.expanded(own, members)[0])
    assert {r.step: r.parameters["IF"] for r in steps.collect() if "IF" in r.parameters} == {"S3": "(S9.RC = 0)", "S4": "NOT (S9.RC = 0)"}
    found = rules.step_rules(steps)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.rule_id, r.line, r.message.split(": ")[-1].split(" ")[-1]) for r in found.collect()} == {("R030", 3, "S2"), ("R046", 7, "S4"), ("R047", 5, "S9"), ("R047", 7, "S9")}


def test_comments_go_first(spark):
    """Comments are neither rows of tokens nor sorted with the statements around them."""
    text = "\n".join(["       DATA DIVISION.", *["      * NOTE"] * 5, "       01 A PIC X."])
    rows = cobol.tokens(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").collect()
    assert sorted(r.pos for r in rows) == [1, 2, 3, 5, 6, 7, 8]
    assert [(r.line, r.word) for r in sorted(rows, key=lambda r: r.pos)] == [(1, "DATA"), (1, "DIVISION"), (1, "."), (7, "01"), (7, "A"), (7, "PIC X"), (7, ".")]
    source = spark.createDataFrame([(1, "* A\nFILE A\n* MEND\n  * B\n A-ID 1 5 N")], "id int, text string")
    found = easytrieve.segmented(easytrieve.lines(source, "id", "text"), ["program"])
    assert sorted((r.nth, r.line, r.text) for r in found.collect()) == [(1, 2, "FILE A"), (2, 5, "A-ID 1 5 N")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Window") < plan.rindex(r"\s*\*")
