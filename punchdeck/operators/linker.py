"""The call graph from facts of all kinds of sources: each function makes the edges of one kind, all as joins.

Edges are ``(from_id, to_id, kind, resolution, line)``, resolution RESOLVED, EXTERNAL (a name that no source has) or
UNRESOLVED (a name that isn't known before the run). Ids are ``KIND:NAME``. ``graph.merged_edges`` and
``sequence.numbered`` make one graph of their union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.functions import columns as C
from punchdeck.operators import graph, ranges, sequence

EDGE = ("from_id", "to_id", "kind", "resolution", "line")
# Libraries that are searched for programs, not read as data.
LIBRARY_DDS = ("STEPLIB", "JOBLIB")


def node(kind: str, name: Column | str) -> Column:
    return F.concat(F.lit(kind + ":"), F.upper(F.col(name) if isinstance(name, str) else name))


def _edges(rows: DataFrame, from_id: Column, to_id: Column, kind: str, resolution: Column | str = "RESOLVED", *more: Column) -> DataFrame:
    said = F.lit(resolution) if isinstance(resolution, str) else resolution
    return rows.select(from_id.alias("from_id"), to_id.alias("to_id"), F.lit(kind).alias("kind"), said.alias("resolution"), "line", *more)


def _known(known: Column) -> Column:
    return F.when(known, "RESOLVED").otherwise("EXTERNAL")


def copy_edges(copies: DataFrame, copybooks: DataFrame) -> DataFrame:
    """``copies(program, copybook, line)`` whose copybook is a file's name: ``copybooks(name)``."""
    met = copies.withColumn("name", F.upper("copybook")).join(copybooks.select(F.upper("name").alias("name")).distinct(), "name")
    return _edges(met, node("PROGRAM", "program"), node("COPYBOOK", "name"), "COPY").distinct()


def importers(copies: DataFrame) -> DataFrame:
    """``(copybook, programs)``: who is affected by a change; a list as long as the copybook has importers."""
    return copies.groupBy(F.upper("copybook").alias("copybook")).agg(F.array_sort(F.collect_set(F.upper("program"))).alias("programs"))


def step_edges(steps: DataFrame, programs: DataFrame, utilities: DataFrame) -> DataFrame:
    """``steps(job, step, target, line)`` -> what they run: a utility of the list, else a program, known or not."""
    target = F.upper("target")
    util = utilities.select(F.upper("name").alias("name"), F.lit(True).alias("util")).distinct()
    prog = programs.select(F.upper("name").alias("name"), F.lit(True).alias("known")).distinct()
    met = steps.withColumn("name", target).join(util, "name", "left").join(prog, "name", "left")
    to = F.when(F.col("util"), node("UTILITY", "name")).otherwise(node("PROGRAM", "name"))
    return _edges(met, node("STEP", F.concat("job", F.lit("."), "step")), to, "EXECUTION", _known(F.coalesce("util", "known", F.lit(False))))


def call_edges(calls: DataFrame, programs: DataFrame, exact: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``calls(program, target, line)`` of literal targets -> a service's owner, else a program, known or not."""
    prog = programs.select(F.upper("name").alias("target"), F.lit(True).alias("known")).distinct()
    met = ranges.owner_by_name(calls.withColumn("target", F.upper("target")), exact, prefixes, "target").join(prog, "target", "left")
    to = F.when(F.col("owner").isNotNull(), node("SERVICE", "owner")).otherwise(node("PROGRAM", "target"))
    return _edges(met, node("PROGRAM", "program"), to, "CALL", _known(F.col("owner").isNotNull() | F.coalesce("known", F.lit(False))))


def resolved_names(uses: DataFrame, constants: DataFrame, variable: str) -> DataFrame:
    """Rows of ``uses(program, …)`` with ``name`` for each constant that the program moves into the variable anywhere,
    or as its VALUE (``constants(program, variable, value)``); null where there is none."""
    held = constants.select(F.upper("program").alias("p_"), F.upper("variable").alias("v_"), F.upper(F.trim("value")).alias("name")).distinct()
    return uses.join(held, (F.upper("program") == F.col("p_")) & (F.upper(variable) == F.col("v_")), "left").drop("p_", "v_")


def dynamic_call_edges(calls: DataFrame, constants: DataFrame, programs: DataFrame) -> DataFrame:
    """``calls(program, variable, line)``: an edge for each constant, or one that stays unresolved."""
    prog = programs.select(F.upper("name").alias("name"), F.lit(True).alias("known")).distinct()
    met = resolved_names(calls, constants, "variable").join(prog, "name", "left")
    to = F.when(F.col("name").isNull(), node("VARIABLE", F.concat("program", F.lit("."), "variable"))).otherwise(node("PROGRAM", "name"))
    return _edges(met, node("PROGRAM", "program"), to, "CALL", F.when(F.col("name").isNull(), "UNRESOLVED").otherwise(_known(F.coalesce("known", F.lit(False)))))


def file_access(opens: DataFrame) -> DataFrame:
    """``opens(program, dd, mode)`` of INPUT, OUTPUT, EXTEND, I-O -> ``(program, dd, access)``."""
    mode = F.upper("mode")
    flags = opens.groupBy(F.upper("program").alias("program"), F.upper("dd").alias("dd")).agg(F.max(mode == "INPUT").alias("r"), F.max(mode.isin("OUTPUT", "EXTEND")).alias("w"), F.max(mode == "I-O").alias("u"))
    return flags.select("program", "dd", F.when(F.col("u") | (F.col("r") & F.col("w")), "UPDATE").when(F.col("w"), "WRITE").when(F.col("r"), "READ").alias("access"))


def runs_of_steps(steps: DataFrame, cards: DataFrame) -> DataFrame:
    """``(job, step, program)`` whose files a step reads: the program it names, or that of its run cards if it is one.

    ``cards(job, step, program)``: what launchers are told to run.
    """
    single = cards.groupBy("job", "step").agg(F.count_distinct(F.upper("program")).alias("n"), F.min(F.upper("program")).alias("run")).filter("n = 1").drop("n")
    any_ = cards.select("job", "step").distinct().withColumn("carded", F.lit(True))
    met = steps.join(single, ["job", "step"], "left").join(any_, ["job", "step"], "left")
    return met.select("job", "step", F.when(F.col("carded"), F.col("run")).otherwise(F.upper("target")).alias("program"))


def data_set_edges(dds: DataFrame, runs: DataFrame, access: DataFrame, roles: DataFrame) -> DataFrame:
    """``dds(job, step, dd, dsn, line)`` -> data sets, with the access of the program's file, else of cards or DISP.

    Libraries and references that aren't resolved are no data.
    """
    rows = dds.filter(F.col("dsn").isNotNull() & ~F.upper("dd").isin(*LIBRARY_DDS) & ~F.startswith("dsn", F.lit("*."))).withColumn("dd", F.upper("dd"))
    met = rows.join(runs.select("job", "step", "program"), ["job", "step"], "left").join(access, ["program", "dd"], "left")
    met = met.join(roles.select("job", "step", F.upper("dd").alias("dd"), F.col("access").alias("role")), ["job", "step", "dd"], "left")
    return _edges(met, node("STEP", F.concat("job", F.lit("."), "step")), node("DATASET", C.dataset(F.col("dsn"))["name"]), "DATASET", "RESOLVED", F.coalesce("access", "role").alias("access"))


def ims_edges(pcbs: DataFrame, databases: DataFrame) -> DataFrame:
    """``pcbs(psb, dbd, line)`` -> data bases; one without a DBD source is external."""
    known = databases.select(F.upper("name").alias("dbd"), F.lit(True).alias("known")).distinct()
    met = pcbs.withColumn("dbd", F.upper("dbd")).join(known, "dbd", "left")
    return _edges(met, node("PSB", "psb"), node("DBD", "dbd"), "DATABASE", _known(F.coalesce("known", F.lit(False)))).distinct()


def queue_edges(constants: DataFrame, calls: DataFrame) -> DataFrame:
    """Queues: constants moved to a name that ends with OBJECTNAME, in programs that open a queue."""
    opens = calls.filter(F.upper("target").isin("MQOPEN", "MQPUT1")).select("program").distinct()
    named = constants.filter(F.upper("variable").endswith("OBJECTNAME")).join(opens, "program", "left_semi")
    return _edges(named, node("PROGRAM", "program"), node("QUEUE", F.trim("value")), "QUEUE").distinct()


def cics_edges(commands: DataFrame, constants: DataFrame) -> DataFrame:
    """``commands(program, verb, operand, literal boolean, line)``: XCTL and LINK go to programs, START and RETURN to
    transactions, SEND and RECEIVE MAP to maps. A variable stands for the constants moved into it."""
    kind = F.when(F.col("verb").isin("XCTL", "LINK"), "PROGRAM").when(F.col("verb").isin("START", "RETURN"), "TRANSACTION").when(F.col("verb").isin("SEND", "RECEIVE"), "MAP")
    rows = commands.withColumn("to_kind", kind).filter("to_kind is not null")
    said = rows.filter("literal").withColumn("name", F.upper("operand"))
    held = resolved_names(rows.filter("not literal"), constants, "operand")
    met = said.unionByName(held)
    to = F.concat(F.when(F.col("name").isNull(), "VARIABLE").otherwise(F.col("to_kind")), F.lit(":"), F.coalesce("name", F.upper(F.concat("program", F.lit("."), "operand"))))
    return _edges(met, node("PROGRAM", "program"), to, "CICS", F.when(F.col("name").isNull(), "UNRESOLVED").otherwise("RESOLVED"))


def transactions(table: DataFrame, defined: DataFrame) -> DataFrame:
    """``(transaction, program, origin)``: the definition table goes before resource definitions. Both ``(transaction, program)``."""
    one = lambda df, c: df.groupBy(F.upper("transaction").alias("transaction")).agg(F.min(F.upper("program")).alias(c))
    met = one(table, "a").join(one(defined, "b"), "transaction", "full")
    return met.select("transaction", F.coalesce("a", "b").alias("program"), F.when(F.col("a").isNotNull(), "TABLE").otherwise("DEFINITION").alias("origin"))


def undefined_transactions(used: DataFrame, known: DataFrame) -> DataFrame:
    return used.withColumn("transaction", F.upper("transaction")).join(known, "transaction", "left_anti")


def sql_call_edges(calls: DataFrame, routines: DataFrame) -> DataFrame:
    """``calls(program, name, line)`` of SQL: a routine by its name without qualifier, else a program."""
    known = routines.select(C.unqualified(F.col("name")).alias("short"), F.lit(True).alias("known")).distinct()
    met = calls.withColumn("short", C.unqualified(F.col("name"))).join(known, "short", "left")
    return _edges(met, node("PROGRAM", "program"), F.when(F.col("known"), node("ROUTINE", "short")).otherwise(node("PROGRAM", "short")), "SQL_CALL", _known(F.coalesce("known", F.lit(False))))


def table_edges(uses: DataFrame) -> DataFrame:
    """``uses(program, table, kind, line)`` of statements -> one edge for each table with its letters in the order R C U D."""
    letter = C.crud_of_kind(F.col("kind"))
    rows = uses.select("program", F.upper("table").alias("table"), "line", F.explode(F.split(letter, "")).alias("letter")).filter("letter <> ''")
    per = rows.groupBy("program", "table").agg(F.collect_set("letter").alias("letters"), F.min("line").alias("line"))
    return _edges(per, node("PROGRAM", "program"), node("TABLE", "table"), "TABLE", "RESOLVED", C.crud(F.col("letters")).alias("access"))


def unlinked_sources(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sources that gave no node of their own, as nodes without edges."""
    return sources.select(F.concat("kind", F.lit(":"), C.member_name(F.col("path"))).alias("id"), "kind", C.member_name(F.col("path")).alias("label")).join(nodes.select("id"), "id", "left_anti")


def call_graph(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all edge tables: identities merged in the order of the parts, numbered by line of their caller."""
    rows = None
    for k, p in enumerate(parts):
        p = p.withColumn("access", F.lit(None).cast("string")) if "access" not in p.columns else p
        p = p.select(*EDGE, "access", F.struct(F.lit(k).alias("part"), "line", "to_id").alias("arrival"))
        rows = p if rows is None else rows.union(p)
    edges = sequence.numbered(graph.merged_edges(rows), "from_id", "line", "arrival").drop("arrival")
    ends = edges.select(F.col("from_id").alias("id"), F.lit(0).alias("priority")).union(edges.select("to_id", F.when(F.col("resolution") == "RESOLVED", 0).otherwise(1)))
    nodes = ends.groupBy("id").agg((F.min("priority") == 1).alias("external"))
    return nodes.select("id", F.substring_index("id", ":", 1).alias("kind"), F.expr("substring(id, instr(id, ':') + 1)").alias("label"), "external"), edges


def target_paths(edges: DataFrame, programs: DataFrame) -> DataFrame:
    """Edges to programs with the path of the program's first source: ``programs(id, name, path)``."""
    first = programs.groupBy(node("PROGRAM", "name").alias("to_id")).agg(F.min_by("path", "id").alias("to_path"))
    return edges.join(first, "to_id", "left")


# ---- procedures of a program ------------------------------------------------------------------------------------


def named_procedures(refs: DataFrame, procedures: DataFrame) -> DataFrame:
    """``refs(program, ref, name, qualifier, section)`` with ``idx`` of the procedure meant: the one in the section that
    qualifies the name, else one in the section of the reference, else the first of that name; null if there is none.

    ``procedures(program, idx, name, section)``.
    """
    p = procedures.select(F.col("program").alias("p_program"), F.upper("name").alias("p_name"), "idx", F.upper("section").alias("p_section"))
    met = refs.join(p, (F.col("program") == F.col("p_program")) & (F.upper("name") == F.col("p_name")) & (F.col("qualifier").isNull() | (F.upper("qualifier") == F.col("p_section"))), "left")
    rank = F.struct(F.when(F.col("p_section").eqNullSafe(F.upper("section")), 0).otherwise(1), "idx")
    return met.groupBy("program", "ref").agg(F.min_by("idx", rank).alias("idx"))


def performed(performs: DataFrame, procedures: DataFrame) -> DataFrame:
    """``performs(program, ref, low, high)`` with each procedure of the range, bounds by ``idx``."""
    return ranges.within(procedures.select("program", "idx", "name"), performs, ["program"], "idx", "low", "high").select("program", "ref", "idx", "name")


def fallthrough(procedures: DataFrame) -> DataFrame:
    """``(program, from_idx, to_idx)``: the next procedure where the statements of one can end normally (``ends``)."""
    nxt = F.lead("idx").over(Window.partitionBy("program").orderBy("idx"))
    return procedures.withColumn("to_idx", nxt).filter("ends and to_idx is not null").select("program", F.col("idx").alias("from_idx"), "to_idx")


def chains(procedures: DataFrame) -> DataFrame:
    """``(program, idx, chain, place)``: runs of procedures that fall through into one another, in order."""
    w = Window.partitionBy("program").orderBy("idx")
    first = F.coalesce(~F.lag("ends").over(w), F.lit(True))
    rows = procedures.withColumn("chain", F.sum(first.cast("int")).over(w))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("program", "chain").orderBy("idx"))).select("program", "idx", "chain", "place")


def mismatched_operands(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """CALL USING against PROCEDURE DIVISION USING by place: ``calls(call, callee, sizes array)`` and
    ``entries(callee, sizes array)`` -> ``(call, callee, pos, passed, taken)``; pos 0 stands for another number."""
    met = calls.join(entries.select("callee", F.col("sizes").alias("want")), "callee")
    count = met.filter(F.size("sizes") != F.size("want")).select("call", "callee", F.lit(0).alias("pos"), F.size("sizes").cast("long").alias("passed"), F.size("want").cast("long").alias("taken"))
    each = met.select("call", "callee", F.posexplode(F.arrays_zip("sizes", "want")).alias("at", "z")).filter("z.sizes < z.want")
    return count.union(each.select("call", "callee", F.col("at") + 1, "z.sizes", "z.want"))
