"""What large inputs cost: steps that run once, plans that do nothing twice."""

from pyspark.sql import functions as F

from punchdeck.operators import control, graph, program_rules, sqlscope
from punchdeck.sources import cobol, scripts

PROGRAM = """       DATA DIVISION.
       WORKING-STORAGE SECTION.
       77  BIG PIC 9(18).
       77  X PIC 9(18).
       77  N PIC 9(4) VALUE 1.
       PROCEDURE DIVISION.
       P-1.
           PERFORM VARYING N FROM 1 BY 1 UNTIL N > 3
             MOVE BIG TO X
           END-PERFORM
           DISPLAY X
           STOP RUN.
"""


def test_a_cut_runs_its_plan_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert graph.cut(spark.range(50).mapInArrow(count, "id long")).count() == 50
    assert seen.value == 50


def test_groups_larger_than_a_batch(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        rows = spark.range(100).select((F.col("id") % 3).alias("program"), (100 - F.col("id")).alias("at"))
        found = graph.each_group(rows, "program", lambda c: [(len(c["at"]), c["at"] == sorted(c["at"]) and "sorted")], "n long, how string", "at").collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(map(tuple, found)) == [(0, 34, "sorted"), (1, 33, "sorted"), (2, 33, "sorted")]


def test_texts_are_taken_apart_once(spark):
    texts = spark.createDataFrame([(1, "SELECT A FROM T; COMMIT"), (2, None), (3, "")], "id long, text string")
    for rows in (cobol.tokens(texts, "id", "text"), scripts.tokens(texts, "id", "text"), sqlscope.tokens(texts.select(F.col("id").alias("stmt"), "text"))):
        assert "Filter ((size(regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r.script for r in scripts.tokens(texts, "id", "text").select("script").distinct().collect()} == {1}


def test_bounds_of_18_digits_are_exact(spark):
    from punchdeck.operators import intervals

    f = program_rules.facts(spark.createDataFrame([(1, PROGRAM)], "id long, text string"), "id", "text")
    found = {(r.name, r.high) for r in intervals.intervals(f.edges, f.stmts, f.procedures, f.items, f.operands).collect()}
    x = [h for n, h in found if n == "X"]
    assert x and all(h in (None, 10**18 - 1) for h in x) and 10**18 - 1 in x


def test_statements_are_taken_apart_once_for_all_rules(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    texts = ["CREATE TABLE S.T (A INT, B INT)", "SELECT * FROM S.T WHERE UPPER(A) = 1 AND Q = 2", "SELECT V FROM S.T", "SELECT * FROM S.T"]
    stmts = spark.createDataFrame(list(enumerate(texts)), "stmt long, text string").mapInArrow(count, "stmt long, text string")
    assert {tuple(r) for r in sqlscope.undeclared_columns(stmts).collect()} == {(1, "T.Q"), (2, "T.V")}
    # once for the declarations, once for the columns
    assert seen.value <= 2 * len(texts)
    held = spark.createDataFrame([(2, "V")], "stmt long, name string")
    found = {tuple(r) for r in sqlscope.findings(stmts, held, F.col("stmt") < 3).collect()}
    assert found == {(1, "S001", "*"), (1, "S002", "function"), (1, "R057", "T.Q")}


def test_scripts_are_split_where_their_rows_are(spark):
    rows = spark.createDataFrame([(1, "SELECT 1; -- x;\nCOMMIT")], "id long, text string")
    plan = scripts.statements(rows, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 1


def test_programs_are_taken_apart_once_for_all_rules(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    texts = spark.createDataFrame([(1, PROGRAM), (2, None), (3, "")], "id long, text string").mapInArrow(count, "id long, text string")
    s = program_rules.sourced(texts, "id", "text")
    assert {tuple(r) for r in program_rules.program_rules(s).collect()} == {(1, 11, "R001", "X")}
    assert seen.value == 3
    f = program_rules.facts(texts, "id", "text")
    for a, b in ((s.items, f.items), (s.procedures, f.procedures), (s.stmts, f.stmts)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.dtypes == b.dtypes
    # a program's graph is made where its rows are
    plan = control.edges(s.stmts, s.procedures)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
