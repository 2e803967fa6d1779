"""Defect rules that follow a program's paths: what is checked before the next of its kind, loops that nothing ends, cursors out of order.

Findings are those of ``program_rules``: ``(program, line, rule_id, subject)``. What the rules ask of a program's graph is gathered and
searched at once (``reached``): its edges are dealt out once, not for each rule, file and cursor.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.functions import columns as C
from punchdeck.operators import control, flow, intervals, operands
from punchdeck.operators.graph import cut
from punchdeck.operators.program_rules import Facts, finding
from punchdeck.sources import cobol

CONDITIONS = ("IF", "EVALUATE", "SEARCH", "PERFORM")
# Registers that change without a statement that names them.
REGISTERS = ("RETURN-CODE", "SQLCODE", "SQLSTATE", "SQLCA", "TALLY", "EIBRESP", "EIBRESP2", "EIBCALEN", "EIBAID", "EIBTRNID")


def condition_parents(items: DataFrame) -> DataFrame:
    """``(program, name, parent)``: the item that each 88-level belongs to."""
    w = Window.partitionBy("program").orderBy("idx")
    parent = F.last(F.when(~F.col("level").isin(66, 88), F.col("name")), ignorenulls=True).over(w)
    return items.withColumn("parent", parent).filter("level = 88").select("program", "name", "parent")


def tested(f: Facts) -> DataFrame:
    """``(program, node, name)``: names in conditions, with the items that condition names belong to."""
    rows = f.stmts.filter(F.col("verb").isin(*CONDITIONS)).select("program", F.col("stmt").alias("node"), F.explode("words").alias("name")).filter(operands.is_name(F.col("name")))
    return rows.union(rows.join(condition_parents(f.items), ["program", "name"]).select("program", "node", "parent")).distinct()


class Asked(NamedTuple):
    """What a rule asks of graphs. ``starts(program, graph, rule, key, node, item)``: ``item`` goes from the end of ``node`` along the graph's edges;
    ``stops(program, graph, rule, key, node)`` end what has their rule and key."""

    starts: DataFrame
    stops: DataFrame


START, STOP = ["program", "graph", "rule", "key", "node", "item"], ["program", "graph", "rule", "key", "node"]
FLOW, LOCAL, CALLS = "flow", "local", "calls"


def _asks(rows: DataFrame, rule: str, graph: str, *columns: str) -> DataFrame:
    given = {"graph": F.lit(graph), "rule": F.lit(rule)}
    return rows.select(*(given[c].alias(c) if c in given else F.col(c) for c in columns))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def reached(graphs: DataFrame, asked: list[Asked]) -> DataFrame:
    """``(program, rule, key, item, node)``: the nodes that items come to, of all rules in one search; ``graphs(program, graph, from_node, to_node)``."""
    graph, name = F.struct("program", "graph").alias("program"), F.struct("rule", "key").alias("name")
    starts, stops = union([a.starts for a in asked]), union([a.stops for a in asked])
    # graphs in which nothing is asked stay where they are
    edges = graphs.join(starts.select("program", "graph").distinct(), ["program", "graph"], "left_semi")
    met = flow.solve(edges.select(graph, "from_node", "to_node"), starts.select(graph, "node", F.col("item").cast("long").alias("item"), name), stops.select(graph, "node", name))
    return met.select("program.program", "name.rule", "name.key", "item", "node")


class Loops(NamedTuple):
    inside: DataFrame
    asked: Asked
    calls: DataFrame


def loops(f: Facts) -> Loops:
    """The statements that PERFORM UNTIL repeats, and what is asked of the graph of ``calls``: the procedures that these perform, and that those perform."""
    numbered = f.stmts.select("program", "stmt", "proc")
    found = cut(control.ranges(f.stmts, f.procedures))
    body = intervals.bodies(f.stmts, f.procedures, found)
    inside = cut(body.join(numbered, "program").filter("stmt between a and b").select("program", F.col("node").alias("loop"), "stmt"))
    runs = cut(found.join(f.procedures.select("program", "idx"), "program").filter("idx between low and high").select("program", "stmt", "idx"))
    first = inside.join(runs, ["program", "stmt"]).select("program", F.col("idx").alias("node"), F.col("loop").alias("item"), F.lit("").alias("key")).distinct()
    calls = runs.join(numbered, ["program", "stmt"]).select("program", F.lit(CALLS).alias("graph"), F.col("proc").alias("from_node"), F.col("idx").alias("to_node")).distinct()
    first = cut(_asks(first, "R012", CALLS, *START))
    return Loops(inside, Asked(first, first.select(*STOP).limit(0)), calls)


def endless_loops(f: Facts, loops: Loops, met: DataFrame) -> DataFrame:
    """R012: a PERFORM UNTIL of which no name in the condition is mentioned in what it repeats, also in what that performs.

    Names that VARYING steps and special registers end a loop; a condition name is mentioned with its item.
    """
    behind = F.slice("words", F.array_position("words", "UNTIL").cast("int") + 1, F.size("words"))
    names = f.stmts.filter((F.col("verb") == "PERFORM") & F.array_contains("words", "UNTIL")).select("program", F.col("stmt").alias("node"), "line", F.posexplode(behind).alias("nth", "name"))
    names = names.filter(operands.is_name(F.col("name")) & ~F.col("name").isin("UNTIL", "VARYING")).join(condition_parents(f.items), ["program", "name"], "left")
    asked = names.groupBy("program", "node", "line").agg(F.collect_set(F.struct("nth", "name", "parent")).alias("asked"))
    more = met.filter("rule = 'R012'").select("program", "node", "item").union(loops.asked.starts.select("program", "node", "item")).distinct()
    performed = more.join(f.stmts.select("program", F.col("proc").alias("node"), "stmt"), ["program", "node"]).select("program", F.col("item").alias("loop"), "stmt")
    within = loops.inside.union(performed).distinct().join(f.stmts.select("program", "stmt", "words"), ["program", "stmt"])
    said = within.select("program", F.col("loop").alias("node"), F.lit(True).alias("here"), F.explode_outer(F.when(F.col("stmt") != F.col("loop"), F.col("words"))).alias("name"))
    said = said.union(f.operands.filter("defined").select("program", "node", F.lit(False), "name")).groupBy("program", "node").agg(F.max("here").alias("here"), F.collect_set("name").alias("said")).filter("here")
    ends = F.exists("asked", lambda x: F.array_contains("said", x["name"]) | F.coalesce(F.array_contains("said", x["parent"]), F.lit(False)) | x["name"].isin(*REGISTERS))
    told = F.array_join(F.array_distinct(F.transform(F.sort_array("asked"), lambda x: x["name"])), ", ")
    return finding(asked.join(said, ["program", "node"]).filter(~ends), "R012", told)


def section_fall_through(f: Facts) -> DataFrame:
    """R014: a section whose last statement is no EXIT, STOP, GOBACK or GO TO one place, and that is followed by another."""
    sections = f.procedures.withColumn("nth", F.count_if(F.col("kind") == "SECTION").over(Window.partitionBy("program").orderBy("idx"))).filter("nth > 0")
    last = f.stmts.filter("parent = 0").join(sections.select("program", F.col("idx").alias("proc"), "section", "nth"), ["program", "proc"])
    last = last.groupBy("program", "nth", "section").agg(F.max_by(F.struct("verb", "words", "line"), "stmt").alias("s")).select("program", "nth", "section", "s.*")
    more = sections.groupBy("program").agg(F.max("nth").alias("most"))
    ends = F.col("verb").isin("STOP", "GOBACK", "EXIT") | F.array_join("words", " ").rlike(rf"^GO(?: TO)? {control._NAME}$")
    return finding(last.join(more, "program").filter((F.col("nth") < F.col("most")) & ~ends), "R014", "section")


class Unchecked(NamedTuple):
    """``starts(program, rule, key, node, line, subject)`` that are told unless a path comes to one of ``checks(program, rule, key, node)`` before a boundary."""

    starts: DataFrame
    checks: DataFrame
    asked: Asked


def _unchecked(rule: str, starts: DataFrame, subject: Column, checks: DataFrame, boundaries: DataFrame) -> Unchecked:
    """All rows have ``(program, key, node)``, starts a ``line`` as well."""
    made = starts.withColumn("item", F.col("node"))
    stops = checks.select("program", "key", "node").union(boundaries.select("program", "key", "node"))
    return Unchecked(starts.select("program", F.lit(rule).alias("rule"), "key", "node", "line", subject.alias("subject")), checks.select("program", F.lit(rule).alias("rule"), "key", "node"), Asked(_asks(made, rule, FLOW, *START), _asks(stops, rule, FLOW, *STOP)))


def unchecked(found: list[Unchecked], met: DataFrame) -> DataFrame:
    checks = union([u.checks for u in found]).distinct()
    checked = met.join(checks, ["program", "rule", "key", "node"]).select("program", "rule", "key", F.col("item").alias("node")).distinct()
    return union([u.starts for u in found]).join(checked, ["program", "rule", "key", "node"], "left_anti").select("program", "line", F.col("rule").alias("rule_id"), "subject")


def unchecked_file_status(f: Facts, tests: DataFrame) -> Unchecked:
    """R017: a READ, WRITE, REWRITE or DELETE from which no path tests the file's status before the next of that file."""
    files = cobol.files(f.tokens).filter("status is not null").select("program", "file", "status")
    records = cobol.records(f.tokens)
    asked = f.stmts.filter("verb in ('READ', 'WRITE', 'REWRITE', 'DELETE')").select("program", F.col("stmt").alias("node"), "line", "verb", F.get("words", F.lit(1)).alias("name"))
    of_record = asked.filter("verb in ('WRITE', 'REWRITE')").join(records.withColumnRenamed("record", "name"), ["program", "name"]).select("program", "node", "line", "verb", "file")
    accesses = cut(asked.filter("verb in ('READ', 'DELETE')").withColumnRenamed("name", "file").select("program", "node", "line", "verb", "file").union(of_record).join(files, ["program", "file"]).withColumn("key", F.col("file")))
    checks = tests.join(files.withColumnRenamed("status", "name"), ["program", "name"]).select("program", "node", F.col("file").alias("key"))
    return _unchecked("R017", accesses, F.concat_ws(" ", "verb", "file"), checks, accesses)


def sql_statements(f: Facts) -> DataFrame:
    """``(program, node, line, sql, kind, cursor)``: EXEC SQL statements of the procedure division, and with a null node those before it."""
    inner = lambda c: F.trim(F.regexp_replace(c, r"(?is)^EXEC\s+SQL\s+|\s*END-EXEC$", ""))
    own = f.stmts.filter("verb = 'EXEC SQL'").select("program", F.col("stmt").cast("int").alias("node"), "line", inner(F.col("text")).alias("sql"))
    before = f.tokens.filter((F.col("division") == "DATA") & F.col("word").rlike(r"^EXEC\s+SQL\s")).select("program", F.lit(None).cast("int"), "line", inner(F.col("token")))
    rows = own.union(before)
    return rows.withColumns({"kind": C.statement_kind(F.col("sql")), "cursor": C.cursor_name(F.col("sql"))})


def unchecked_sqlcode(sql: DataFrame, tests: DataFrame) -> Unchecked:
    """R018: an SQL statement that changes or reads rows from which no path tests SQLCODE or SQLSTATE before the next EXEC SQL.

    A WHENEVER with an action before it in the source takes care of errors; for what may find no row one of NOT FOUND
    has to be in effect as well. GET DIAGNOSTICS is a test.
    """
    w = Window.partitionBy("program").orderBy(F.col("node").asc_nulls_first(), "line").rowsBetween(Window.unboundedPreceding, -1)
    clause = C.whenever(F.col("sql"))
    effect = lambda name: F.coalesce(F.last(F.when(clause["condition"] == name, clause["action"] != "CONTINUE"), ignorenulls=True).over(w), F.lit(False))
    sql = cut(sql.withColumns({"errors": effect("SQLERROR"), "empty": effect("NOT FOUND"), "key": F.lit("")}))
    starts = sql.filter("node is not null and kind in ('INSERT', 'UPDATE', 'DELETE', 'SELECT_INTO', 'FETCH') and not (errors and (kind = 'INSERT' or empty))")
    checks = tests.filter("name in ('SQLCODE', 'SQLSTATE')").select("program", "node", F.lit("").alias("key")).union(sql.filter("kind = 'GET_DIAGNOSTICS'").select("program", "node", "key"))
    return _unchecked("R018", starts, F.col("kind"), checks, sql.filter("node is not null and kind <> 'GET_DIAGNOSTICS'"))


def open_cursors(sql: DataFrame) -> DataFrame:
    """R019: a cursor that is declared and opened and that nothing closes, at its first OPEN."""
    sql = sql.filter("cursor is not null")
    of = sql.groupBy("program", "cursor").agg(*(F.max(F.col("kind") == k).alias(k) for k in ("DECLARE_CURSOR", "OPEN", "CLOSE")), F.min_by("line", F.when(F.col("kind") == "OPEN", F.struct("node", "line"))).alias("line"))
    return finding(of.filter("DECLARE_CURSOR and OPEN and not CLOSE"), "R019", "cursor")


class Cursors(NamedTuple):
    """``at_once(program, line, cursor, defect)`` is told; of what is ``asked``, whose rules are the defects, ``wanted(program, rule, key, node, line)`` tell."""

    at_once: DataFrame
    wanted: DataFrame
    asked: list[Asked]
    local: DataFrame


def cursor_order(f: Facts, sql: DataFrame) -> Cursors:
    """R055: a cursor declared and never opened; a FETCH or CLOSE of one that nothing opens, or that its paragraph reaches past
    its own OPEN; an OPEN reached from an OPEN without CLOSE, ROLLBACK or (unless WITH HOLD) COMMIT; a FETCH reached from a ROLLBACK without
    an OPEN. Each is told once for a cursor, at its first statement; the subject is CURSOR:DEFECT."""
    of = sql.filter("cursor is not null").groupBy("program", "cursor").agg(
        F.max(F.col("kind").isin("OPEN", "ALLOCATE_CURSOR")).alias("opened"), F.max(F.col("kind") == "DECLARE_CURSOR").alias("declared"), F.min_by("line", F.when(F.col("kind") == "DECLARE_CURSOR", F.struct("node", "line"))).alias("at"),
        F.min_by("line", F.when(F.col("kind").isin("FETCH", "CLOSE"), F.struct("node", "line"))).alias("used_at"), F.max(F.upper("sql").rlike(r"\bWITH\s+HOLD\b")).alias("holds"),
    )
    of = cut(of)
    never = of.filter("not opened and declared").select("program", F.col("at").alias("line"), "cursor", F.lit("never opened").alias("defect"))
    none = of.filter("not opened and not declared and used_at is not null").select("program", F.col("used_at"), "cursor", F.lit("no open"))
    nodes = sql.filter("node is not null")
    keys = of.filter("opened").select("program", F.col("cursor").alias("key"))
    mine = cut(nodes.withColumn("key", F.col("cursor")).join(keys, ["program", "key"], "left_semi").select("program", "key", "node", "line", "kind"))
    opens, closes, fetches = (mine.filter(F.col("kind").isin(*k)) for k in (("OPEN", "ALLOCATE_CURSOR"), ("CLOSE",), ("FETCH",)))
    ended = nodes.filter("kind in ('ROLLBACK', 'COMMIT')").join(of.filter("opened").select("program", F.col("cursor").alias("key"), "holds"), "program").filter("kind = 'ROLLBACK' or not holds").select("program", "key", "node", "kind")
    stops = lambda *parts: union([x.select("program", "key", "node") for x in parts])
    ask = lambda rule, graph, starts, ends: Asked(_asks(starts.withColumn("item", F.lit(0)), rule, graph, *START), _asks(ends, rule, graph, *STOP))
    # within a paragraph that opens the cursor: from its first statement past the OPEN
    place = f.stmts.select("program", F.col("stmt").alias("node"), "proc")
    heads = f.stmts.groupBy("program", "proc").agg(F.min("stmt").alias("head"))
    opening = opens.join(place, ["program", "node"]).select("program", "key", "proc").distinct().join(heads, ["program", "proc"])
    begun = opening.select("program", "proc").distinct()
    inside = place.join(begun, ["program", "proc"], "left_semi")
    local = f.edges.join(inside.select("program", F.col("node").alias("from_node"), "proc"), ["program", "from_node"]).join(inside.select("program", F.col("node").alias("to_node"), F.col("proc").alias("to_proc")), ["program", "to_node"]).filter("proc = to_proc")
    starts = cut(opening.select("program", "key", F.col("head").alias("node")).join(opens.select("program", "key", "node"), ["program", "key", "node"], "left_anti"))
    uses = mine.filter("kind in ('FETCH', 'CLOSE')")
    at_once = starts.join(uses, ["program", "key", "node"]).select("program", "line", F.col("key").alias("cursor"), F.lit("no open").alias("defect"))
    asked = [
        ask("second open", FLOW, opens, stops(opens, closes, ended)), ask("fetch after rollback", FLOW, ended.filter("kind = 'ROLLBACK'"), stops(opens)),
        ask("no open", LOCAL, starts, stops(opens)),
    ]
    wanted = union([x.select("program", F.lit(rule).alias("rule"), "key", "node", "line") for rule, x in (("second open", opens), ("fetch after rollback", fetches), ("no open", uses))])
    return Cursors(union([never, none, at_once]), wanted, asked, local.select("program", F.lit(LOCAL).alias("graph"), "from_node", "to_node"))


def cursors_out_of_order(found: Cursors, met: DataFrame) -> DataFrame:
    told = met.join(found.wanted, ["program", "rule", "key", "node"]).groupBy("program", "rule", "key").agg(F.min_by("line", "node").alias("line"))
    told = found.at_once.union(told.select("program", "line", F.col("key").alias("cursor"), F.col("rule").alias("defect")))
    return finding(told.groupBy("program", "cursor", "defect").agg(F.min("line").alias("line")), "R055", F.concat_ws(":", "cursor", "defect"))


def unchecked_return_code(f: Facts, services: Column | None = None) -> Unchecked:
    """R029: in programs that mention RETURN-CODE, a CALL from which no path tests it before the next CALL. ``services`` tells of a statement
    whether it calls a system service; those are no CALLs here."""
    said = f.stmts.filter(F.array_contains("words", "RETURN-CODE")).select("program").distinct()
    calls = cut(f.stmts.filter((F.col("verb") == "CALL") & ~(F.lit(False) if services is None else services)).join(said, "program").select("program", F.col("stmt").alias("node"), "line", F.upper(F.regexp_replace(F.get("words", F.lit(1)), "['\"]", "")).alias("target"), F.lit("").alias("key")))
    checks = f.stmts.filter(F.col("verb").isin("IF", "EVALUATE", "SEARCH") | ((F.col("verb") == "PERFORM") & F.col("loop").isNotNull())).filter(F.array_contains("words", "RETURN-CODE")).select("program", F.col("stmt").alias("node"), F.lit("").alias("key"))
    return _unchecked("R029", calls, F.col("target"), checks, calls)


def path_rules(f: Facts) -> DataFrame:
    tests, sql, repeated = cut(tested(f)), cut(sql_statements(f)), loops(f)
    found = [unchecked_file_status(f, tests), unchecked_sqlcode(sql, tests), unchecked_return_code(f)]
    cursors = cursor_order(f, sql)
    graphs = union([f.edges.select("program", F.lit(FLOW).alias("graph"), "from_node", "to_node"), cursors.local, repeated.calls])
    met = cut(reached(graphs, [*(u.asked for u in found), *cursors.asked, repeated.asked]))
    return union([endless_loops(f, repeated, met), section_fall_through(f), unchecked(found, met), open_cursors(sql), cursors_out_of_order(cursors, met)])
