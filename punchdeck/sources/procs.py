"""Procedures, INCLUDE members, symbols and referbacks of JCL statements: from ``jcl.parse`` rows to the steps that run.

A job's steps are joined with the bodies of the procedures that they call, a level in each round, so the joins grow with
the calls and not with all members; each round is cut with a table in the shared folder. A step keeps its place as an array of numbers, one for each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.functions.columns import member_name
from punchdeck.operators.graph import cut, written

#: Levels of calls and of INCLUDE; what lies deeper stays as it is written.
DEPTH = 8

# Keywords of EXEC that override those of a procedure's steps; others are values of its symbols.
OVERRIDING = ("ACCT", "ADDRSPC", "COND", "DYNAMNBR", "PARM", "PERFORM", "RD", "REGION", "REGIONX", "TIME")


def nothing() -> Column:
    """A scope without symbols."""
    return F.array().cast("array<struct<k:string,v:string>>")


def entries(parameters: Column) -> Column:
    """Pairs of a map, for scopes in which the last pair of a name counts."""
    return F.coalesce(F.transform(F.map_entries(parameters), lambda e: F.struct(F.upper(e["key"]).alias("k"), e["value"].alias("v"))), nothing())


def substituted(text: Column, scope: Column) -> Column:
    """``&NAME`` and ``&NAME.`` as ``scope`` says, in one pass: values aren't searched again.

    Unknown symbols, ``&&NAME``, names of over 8 characters and substrings (``&NAME(2:1)``) stay as written.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(&&|&[A-Z@#$][A-Z0-9@#$]*\.?\(\d+:\d+\)|&[A-Z@#$][A-Z0-9@#$]{8,}|&[A-Z@#$][A-Z0-9@#$]{0,7}\.?|&|[^&]+)"), 1)
    name = lambda x: F.regexp_extract(x, r"^&([A-Z@#$][A-Z0-9@#$]{0,7})\.?$", 1)
    value = lambda x: F.try_element_at(F.filter(scope, lambda e: e["k"] == name(x)), F.lit(-1))["v"]
    return F.when(text.contains("&"), F.array_join(F.transform(parts, lambda x: F.when(name(x) == "", x).otherwise(F.coalesce(value(x), x))), "")).otherwise(text)


def included(stmts: DataFrame, members: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Statements with those of INCLUDE members in their place; ``members`` are ``jcl.parse`` rows of member files.

    A member that isn't there leaves its INCLUDE. ``file`` stays that of the job, ``source`` is the file of the line.
    """
    columns = [c for c in stmts.columns if c != "seq"]
    rows = stmts.select(*columns, F.array("seq").alias("at"), F.col("file").alias("source"))
    owner = member_name(F.col("file"))
    # of two files of one name the first by its path is taken
    first = members.groupBy(owner.alias("member")).agg(F.min("file").alias("file")).join(members, "file")
    first = first.select("member", F.col("file").alias("source_"), F.col("seq").alias("seq_"), *(F.col(c).alias(c + "_") for c in columns if c != "file"))
    wanted = F.when(F.col("kind") == "INCLUDE", F.upper(F.col("parameters")["MEMBER"]))
    first, rows = cut(first), cut(rows)
    for _ in range(depth):
        calls = rows.withColumn("member", wanted).filter("member is not null").join(first.select("member").distinct(), "member", "left_semi")
        if calls.isEmpty():
            break
        brought = calls.select("member", "file", "at").join(first, "member")
        brought = brought.select("file", *(F.col(c + "_").alias(c) for c in columns if c != "file"), F.concat("at", F.array("seq_")).alias("at"), F.col("source_").alias("source"))
        # the INCLUDE gives way only where its member is there
        left = rows.withColumn("member", wanted).join(first.select("member").distinct(), "member", "left_anti")
        rows = left.select(*columns, "at", "source").unionByName(brought.select(*columns, "at", "source"))
        rows = cut(rows)
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).cast("int")).drop("at")


def laid_out(stmts: DataFrame) -> DataFrame:
    """Statements with the job, the procedure (in-stream or a member's), the step they belong to and the SETs before them."""
    start = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    bound = F.when(F.col("kind") == "PROC", F.coalesce(F.nullif(F.upper("name"), F.lit("")), member_name(F.col("file")))).when(F.col("kind").isin("PEND", "JOB"), "")
    rows = stmts.withColumns({
        "job": F.last(F.when(F.col("kind") == "JOB", F.upper("name")), ignorenulls=True).over(start),
        "job_no": F.sum((F.col("kind") == "JOB").cast("int")).over(start).cast("int"),
        "proc": F.nullif(F.last(bound, ignorenulls=True).over(start), F.lit("")),
    })
    w = Window.partitionBy("file", "job_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "step_no": F.sum((F.col("kind") == "EXEC").cast("int")).over(w).cast("int"),
        "sets": F.flatten(F.collect_list(F.when(F.col("kind") == "SET", entries(F.col("parameters")))).over(w)),
    })
    # a member without a PROC statement is a procedure as a whole
    return rows.withColumn("proc", F.coalesce("proc", F.when(F.col("job").isNull(), member_name(F.col("file")))))


def steps_of(rows: DataFrame) -> DataFrame:
    p = F.col("parameters")
    return rows.filter("kind = 'EXEC'").select(
        "file", "job", "proc", "line", F.array("job_no", "step_no").alias("at"), F.upper("name").alias("step"),
        F.when(p["PGM"].isNotNull(), "PGM").otherwise("PROC").alias("exec_kind"), F.coalesce(p["PGM"], p["PROC"], "positional").alias("target"), p.alias("parameters"), F.col("sets").alias("scope"),
    )


def dds_of(rows: DataFrame) -> DataFrame:
    """DDs with their place in a concatenation: part 0 has the name."""
    step = Window.partitionBy("file", "job_no", "step_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    named = F.nullif(F.upper("name"), F.lit(""))
    rows = rows.filter("kind = 'DD'").withColumns({"dd": F.last(named, ignorenulls=True).over(step), "no": F.sum(named.isNotNull().cast("int")).over(step)})
    part = F.row_number().over(Window.partitionBy("file", "job_no", "step_no", "no").orderBy("seq")) - 1
    return rows.select("file", "proc", "line", F.array("job_no", "step_no").alias("at"), "dd", part.alias("part"), "seq", "positional", "parameters", F.col("sets").alias("scope"))


def replaced(parameters: Column, scope: Column) -> Column:
    return F.transform_values(parameters, lambda _, v: substituted(v, scope))


def merged(base: Column, over: Column) -> Column:
    """A map whose keys of ``over`` go before those of ``base``; either may be null."""
    none = F.create_map().cast("map<string,string>")
    base, over = F.coalesce(base, none), F.coalesce(over, none)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def overriding(given: Column, step: Column, first: Column) -> Column:
    """Keywords of a call that a step of its procedure takes: its own (``COND.STEP``), else PARM at the first step, others at all."""
    general = F.map_filter(given, lambda k, _: k.isin(*OVERRIDING) & ((k != "PARM") | first))
    own = F.map_from_entries(F.transform(F.filter(F.map_entries(given), lambda e: e["key"].endswith(F.concat(F.lit("."), step))), lambda e: F.struct(F.substring_index(e["key"], ".", 1), e["value"])))
    return merged(general, own)


def expanded(stmts: DataFrame, members: DataFrame, depth: int = DEPTH, with_dds: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """``(steps, dds)`` of the jobs in ``stmts``: procedures expanded, overrides applied, symbols replaced.

    Both arguments are ``jcl.parse`` rows, of jobs and of member files. Steps: ``file, job, at, step, exec_kind, target,
    parameters``, in the order of ``at``; a call's own row stays, of kind PROC, before its steps, which are named
    ``CALL.STEP``. DDs: ``file, at, dd, part, ord, positional, parameters``, part 0 for the named DD and more for those
    concatenated to it. In-stream procedures go before members of their name, of two members of a name the first by its
    path. A procedure that isn't there, or that calls itself, leaves its call with its DDs; so does an override that finds no step.
    Without ``with_dds`` the steps alone are made, which need none of them.
    """
    own, library = written(laid_out(stmts)), written(laid_out(members))
    held = own.filter("proc is not null and job is not null").drop("source").unionByName(library.drop("source").filter("proc is not null and job is null"))
    # few statements stand in procedures; a written table tells how small it is, so that calls meet it where they are
    held = written(held)
    known = held.filter("kind = 'EXEC'").groupBy(F.col("file").alias("lib"), F.upper("proc").alias("name")).agg(F.min(F.col("job_no") > 0).alias("instream"))
    instream = known.filter("instream").select(F.col("lib").alias("file"), F.col("name").alias("target"), F.col("lib").alias("own_lib"))
    shared = known.filter("not instream").groupBy(F.col("name").alias("target")).agg(F.min("lib").alias("shared_lib"))
    defaults = held.filter("kind = 'PROC'").groupBy(F.col("file").alias("lib"), F.upper("proc").alias("name")).agg(F.min_by(entries(F.col("parameters")), "seq").alias("defaults"))
    body = steps_of(held).withColumn("name", F.upper("proc"))
    leading = body.groupBy("file", "name").agg(F.min("at").alias("first_at"))
    body = body.join(leading, ["file", "name"]).select(F.col("file").alias("lib"), "name", F.element_at("at", -1).alias("k"), (F.col("at") == F.col("first_at")).alias("first"), F.col("step").alias("step_"), F.col("exec_kind").alias("kind_"), F.col("target").alias("target_"), F.col("parameters").alias("parameters_"), F.col("line").alias("line_"), F.col("scope").alias("sets_"))
    body_dds = dds_of(held).select(F.col("file").alias("lib"), F.upper("proc").alias("name"), F.element_at("at", -1).alias("k"), "dd", "part", F.col("seq").alias("ord"), "positional", "parameters")

    scope = F.col("scope")
    front = steps_of(own.filter("proc is null")).drop("proc").withColumns({"target": F.upper(substituted(F.col("target"), scope)), "parameters": replaced(F.col("parameters"), scope), "chain": F.array().cast("array<string>")})
    dds = dds_of(own.filter("proc is null")).select("file", "at", "dd", "part", F.col("seq").alias("ord"), "positional", replaced(F.col("parameters"), scope).alias("parameters"))
    instream, shared, defaults, body, front = map(written, (instream, shared, defaults, body, front))
    if with_dds:
        body_dds, dds = written(body_dds), written(dds)
    steps = front
    for _ in range(depth):
        calls = front.filter("exec_kind = 'PROC'").join(instream, ["file", "target"], "left").join(shared, "target", "left")
        calls = calls.withColumn("lib", F.coalesce("own_lib", "shared_lib")).withColumn("name", F.col("target")).filter(F.col("lib").isNotNull() & ~F.array_contains("chain", F.col("target")))
        calls = written(calls)
        if calls.isEmpty():
            break
        calls = calls.join(defaults, ["lib", "name"], "left").withColumn("scope", F.concat("scope", F.coalesce("defaults", nothing()), entries(F.col("parameters"))))
        calls = calls.select("file", "job", "lib", "name", F.col("at").alias("call_at"), F.col("step").alias("call"), F.col("parameters").alias("given"), "scope", F.concat("chain", F.array("target")).alias("chain"))
        met = calls.join(body, ["lib", "name"])
        values = F.concat("scope", "sets_")
        base = replaced(F.col("parameters_"), values)
        base = F.when(F.map_contains_key("given", "PARM") & ~F.col("first"), F.map_filter(base, lambda k, _: k != "PARM")).otherwise(base)
        front = met.select(
            "file", "job", F.col("line_").alias("line"), F.concat("call_at", F.array("k")).alias("at"), F.concat_ws(".", "call", "step_").alias("step"), F.col("kind_").alias("exec_kind"),
            F.upper(substituted(F.col("target_"), values)).alias("target"), merged(base, overriding(F.col("given"), F.col("step_"), F.col("first"))).alias("parameters"), values.alias("scope"), "chain",
        )
        front = written(front)
        steps = steps.unionByName(front)
        if not with_dds:
            continue
        brought = calls.join(body_dds, ["lib", "name"]).select("file", F.concat("call_at", F.array("k")).alias("at"), "dd", "part", "ord", "positional", replaced(F.col("parameters"), F.col("scope")).alias("parameters"))
        # a call's DDs go to the step they name, else to the first
        targets = met.select("file", "call_at", "k", "first", "step_")
        asked = F.when(F.col("dd").contains("."), F.substring_index("dd", ".", 1))
        placed = dds.withColumn("asked", asked).withColumnRenamed("at", "call_at").join(targets, ["file", "call_at"])
        placed = placed.filter((F.col("asked") == F.col("step_")) | (F.col("asked").isNull() & F.col("first")))
        over = placed.select("file", F.concat("call_at", F.array("k")).alias("at"), F.substring_index("dd", ".", -1).alias("dd"), "part", F.col("ord").alias("o_"), F.col("positional").alias("p_"), F.col("parameters").alias("m_"))
        gone = placed.select("file", F.col("call_at").alias("at"), "dd", "part").distinct()
        laid = brought.join(over, ["file", "at", "dd", "part"], "full")
        names_data = F.coalesce(F.map_contains_key("m_", "DSN") | F.map_contains_key("m_", "DSNAME"), F.lit(False))
        laid = laid.select("file", "at", "dd", "part", F.coalesce("ord", F.col("o_") + (1 << 20)).alias("ord"), F.when(names_data, F.col("p_")).otherwise(F.coalesce("p_", "positional")).alias("positional"), merged(F.col("parameters"), F.col("m_")).alias("parameters"))
        dds = dds.join(gone, ["file", "at", "dd", "part"], "left_anti").unionByName(laid)
        dds = cut(dds)
    return steps.select("file", "job", "line", "at", "step", "exec_kind", "target", "parameters"), dds if with_dds else None


def referbacks(steps: DataFrame, dds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """DDs with ``dsn``, and ``referback`` where it was found through one; ``missed`` marks those that name no earlier DD.

    ``*.DD`` is a DD before it in the step, ``*.STEP.DD`` and ``*.CALL.STEP.DD`` one of the step itself or of an earlier
    step, in a procedure first of the same call. A referback to a referback is followed up to ``depth`` times.
    """
    p = F.col("parameters")
    rows = dds.join(steps.select("file", "at", F.upper("step").alias("step"), "job"), ["file", "at"], "left")
    rows = rows.withColumns({"dsn": F.coalesce(p["DSN"], p["DSNAME"]), "referback": F.lit(None).cast("string"), "missed": F.lit(False)})
    key = ["file", "at", "dd", "part", "ord"]
    rows = cut(rows)
    for _ in range(depth):
        open_ = rows.filter("dsn like '*.%' and not missed")
        if open_.isEmpty():
            break
        path = F.split(F.substring(F.upper("dsn"), 3, 1 << 10), r"\.")
        asked = open_.select(*key, "step", F.element_at(path, -1).alias("dd_"), F.nullif(F.array_join(F.slice(path, F.lit(1), F.size(path) - 1), "."), F.lit("")).alias("step_"))
        call = F.when(F.col("step").contains("."), F.regexp_extract("step", r"^(.*)\.", 1))
        named = F.when(F.col("step_").isNull(), F.array("step")).otherwise(F.array_compact(F.array(F.concat(call, F.lit("."), F.col("step_")), F.col("step_"))))
        asked = asked.withColumn("named", named).select(*key, "dd_", F.posexplode("named").alias("rank", "named"))
        there = rows.filter("part = 0").select("file", F.col("at").alias("t_at"), F.col("dd").alias("dd_"), F.col("ord").alias("t_ord"), F.col("step").alias("named"), F.col("dsn").alias("t_dsn"))
        met = asked.join(there, ["file", "dd_", "named"]).filter((F.element_at("at", 1) == F.element_at("t_at", 1)) & (F.col("t_at") <= F.col("at")) & ((F.col("t_at") != F.col("at")) | (F.col("t_ord") < F.col("ord"))))
        best = met.groupBy(*key).agg(F.min_by(F.struct("t_dsn"), F.struct("rank", F.col("t_at") != F.col("at"), "t_at", "t_ord")).alias("t"))
        pending = F.col("dsn").like("*.%") & ~F.col("missed")
        rows = rows.join(best, key, "left").withColumns({
            "missed": F.col("missed") | F.coalesce(pending & F.col("t").isNull(), F.lit(False)), "referback": F.when(pending & F.col("t").isNotNull(), F.coalesce("referback", "dsn")).otherwise(F.col("referback")),
            "dsn": F.when(pending & F.col("t").isNotNull(), F.col("t.t_dsn")).otherwise(F.col("dsn")),
        }).drop("t")
        rows = cut(rows)
    return rows
