"""Defect rules over facts: each gives findings ``(rule_id, level, file, line, message)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.functions import columns as C
from punchdeck.sources import cards


# Parameters that say that a DD allocates something new or is no data set.
NEW_ALLOCATION = ("SPACE", "DATACLAS", "LIKE", "REFDD", "PATH", "SUBSYS", "SYSOUT", "AMP", "LABEL", "DDNAME")


def finding(rows: DataFrame, rule: str, level: str, *message: Column | str) -> DataFrame:
    text = F.concat(*(F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("")) for m in message))
    return rows.select(F.lit(rule).alias("rule_id"), F.lit(level).alias("level"), "file", "line", text.alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def jcl_rules(jobs: DataFrame, steps: DataFrame, dds: DataFrame) -> DataFrame:
    p = F.col("parameters")
    d = dds.withColumns({"disp": C.disposition(F.coalesce("disp_text", F.lit(""))), "ds": C.dataset(F.col("dsn"))})
    named = d.filter("dsn is not null and not ds.temporary and ds.referback is null")
    job = Window.partitionBy("file", "job")
    out = []
    late = steps.withColumn("n", F.row_number().over(job.orderBy("step_no"))).filter("n > 1 and cond is null").filter(p["IF"].isNull())
    held = F.array_sort(F.collect_list(F.struct("step_no", "step")))  # steps of one job
    per_job = late.groupBy("file", "job").agg(F.min_by("line", "step_no").alias("line"), F.transform(held, lambda x: x["step"]).alias("all"))
    names = F.concat(F.array_join(F.slice("all", 1, 5), ", "), F.when(F.size("all") > 5, F.concat(F.lit(" and "), F.size("all") - 5, F.lit(" more"))).otherwise(""))
    out.append(finding(per_job, "R030", "warning", "steps run whatever the steps before returned: ", names))
    out.append(finding(named.filter("disp.status = 'NEW' and disp.normal in ('CATLG', 'KEEP') and coalesce(disp.abnormal, '') in ('', 'CATLG', 'KEEP')"), "R032", "warning", "new data set stays after an abend: ", F.col("dsn")))
    code, op = (F.regexp_extract_all(F.upper("cond"), F.lit(r"(\d+) ?, ?(EQ|NE|GT|GE|LT|LE)\b"), k) for k in (1, 2))
    bypass = F.exists(F.zip_with(code, op, lambda c, o: C.bypasses_at_zero(o, c.cast("int"))), lambda x: x)
    last = steps.withColumns({"back": F.row_number().over(job.orderBy(F.desc("step_no"))), "n": F.count("*").over(job)})
    out.append(finding(last.filter((F.col("back") == 1) & (F.col("n") >= 2) & F.col("cond").isNotNull() & bypass), "R046", "warning", "last step is skipped when all goes well: ", F.col("step")))
    named_steps = F.regexp_extract_all(F.upper("cond"), F.lit(r", ?(?:EQ|NE|GT|GE|LT|LE) ?, ?([A-Z0-9@#$.]+)"), 1)
    asked = steps.filter("cond is not null").select("file", "line", "job", "step_no", F.posexplode(named_steps).alias("at", "asked"))
    known = steps.select("file", "job", "step", "step_no").union(steps.filter("step like '%.%'").select("file", "job", F.substring_index("step", ".", -1), "step_no"))
    earlier = known.groupBy("file", "job", F.col("step").alias("asked")).agg(F.min("step_no").alias("first"))
    missing = asked.join(earlier, ["file", "job", "asked"], "left").filter("first is null or first >= step_no")
    missing = missing.groupBy("file", "line", "job", "step_no").agg(F.min_by("asked", "at").alias("asked"))  # a step is reported once
    out.append(finding(missing, "R047", "error", "no earlier step is called ", F.col("asked")))
    twice = d.filter("opens").withColumn("n", F.row_number().over(Window.partitionBy("file", "job", "step_no", "dd").orderBy("seq"))).filter("n > 1")
    out.append(finding(twice, "R051", "error", "second DD of this name in the step: ", F.col("dd")))
    out.append(finding(jobs.filter(p["RESTART"].isNotNull() | p["TYPRUN"].isNotNull()), "R053", "warning", "operator parameter left on JOB ", F.col("job")))
    made = named.filter("ds.gdg > 0 and disp.status not in ('SHR', 'OLD')").groupBy("file", "job", "ds.name").agg(F.min("step_no").alias("made"))
    own = named.filter("ds.gdg > 0").select("file", "job", "ds.name", "step_no").distinct()
    read = named.filter("ds.gdg = 0 and disp.status <> 'NEW'").withColumn("name", F.col("ds.name")).join(made, ["file", "job", "name"]).filter("made < step_no").join(own, ["file", "job", "name", "step_no"], "left_anti")
    out.append(finding(read, "R060", "error", "generation 0 is read after +1 was made: ", F.col("name")))
    temp = d.filter("ds.temporary").withColumn("name", F.upper("ds.name"))
    of_step = temp.groupBy("file", "job", "step_no", "name").agg(F.max_by(F.coalesce(F.col("disp.normal") == "PASS", F.lit(False)), "seq").alias("passed"), F.min("seq").alias("seq"))
    of_step = of_step.withColumn("before", F.lag("passed").over(Window.partitionBy("file", "job", "name").orderBy("step_no"))).filter("not coalesce(before, false)")
    lost = temp.filter("disp.status in ('OLD', 'SHR')").join(of_step.select("file", "job", "step_no", "name", "seq"), ["file", "job", "step_no", "name", "seq"])
    out.append(finding(lost, "R062", "error", "temporary data set was not passed on: ", F.col("name")))
    gone = named.join(steps.filter("target = 'IEFBR14'").select("file", "job", "step_no"), ["file", "job", "step_no"], "left_semi").filter("disp.status in ('OLD', 'SHR') and disp.normal = 'DELETE'")
    out.append(finding(gone, "R063", "warning", "deletion fails where the data set does not exist: ", F.col("dsn")))
    plain = F.regexp_replace("parm", r"^\((.*)\)$", "$1")
    out.append(finding(steps.filter((F.length(plain) > 100) & ~F.col("parm").contains("&")), "R065", "error", "PARM has more than 100 characters"))
    parts = F.split("ds.name", r"\.")
    judged = named.filter(~F.col("dsn").rlike(r"['/&]"))
    wrong = F.exists(parts, lambda q: (F.length(q) > 8) | ~q.rlike(r"^[A-Z$#@][A-Z0-9$#@-]*$")) | (F.length("ds.name") > 44) | (F.col("ds.gdg").isNotNull() & (F.length("ds.name") > 35)) | (F.length("ds.member") > 8)
    out.append(finding(judged.filter(wrong), "R066", "error", "no valid data set name: ", F.col("dsn")))
    keys = F.map_keys("parameters")
    allocated = F.arrays_overlap(keys, F.array(*map(F.lit, NEW_ALLOCATION)))
    out.append(finding(named.filter(F.col("disp_text").isNull() & ~allocated & (F.size("instream") == 0)).join(steps.filter("exec_kind = 'PGM'").select("file", "step_no"), ["file", "step_no"], "left_semi"), "R067", "error", "DISP is left out, so a new data set is asked for: ", F.col("dsn")))
    timed = jobs.select("file", "line", p["TIME"].alias("time")).union(steps.select("file", "line", p["TIME"]))
    out.append(finding(timed.filter(F.regexp_replace("time", "[()]", "").isin("1440", "NOLIMIT", "MAXIMUM")), "R069", "warning", "no limit of CPU time"))
    same = steps.filter("step <> ''").withColumn("n", F.row_number().over(Window.partitionBy("file", "job", "step").orderBy("step_no"))).filter("n > 1")
    out.append(finding(same, "R070", "warning", "second step of this name: ", F.col("step")))
    return union(out)


def step_rules(steps: DataFrame) -> DataFrame:
    """R030, R046 and R047 over steps with procedures expanded (``procs.expanded`` of ``jcl.guarded`` statements): ``file, job, line, at, step, exec_kind, parameters``.

    R030: steps that run whatever those before returned, one finding a job. A job's first step and a call's first are not
    asked for a condition; the steps of a call are not either if the call, or one around it, has one or is told already.
    R046 looks at the COND of the last step alone, R047 at the steps that COND and IF name.
    """
    p = F.col("parameters")
    rows = steps.select("file", "job", "line", "at", "step", "exec_kind", p["COND"].alias("cond"), p["IF"].alias("guard"))
    code, op = (F.regexp_extract_all(F.upper("cond"), F.lit(r"(\d+) ?, ?(EQ|NE|GT|GE|LT|LE)\b"), k) for k in (1, 2))
    bypass = F.coalesce(F.exists(F.zip_with(code, op, lambda c, o: C.bypasses_at_zero(o, c.cast("int"))), lambda x: x), F.lit(False))
    none = F.array().cast("array<string>")
    by_cond = F.when(F.col("cond").isNotNull(), F.regexp_extract_all(F.upper("cond"), F.lit(r", ?(?:EQ|NE|GT|GE|LT|LE) ?, ?([A-Z0-9@#$.]+)"), F.lit(1))).otherwise(none)
    by_if = F.when(F.col("guard").isNotNull(), F.regexp_extract_all(F.upper("guard"), F.lit(r"(?<![A-Z0-9@#$.])([A-Z@#$][A-Z0-9@#$]*(?:\.[A-Z@#$][A-Z0-9@#$]*)?)\.(?:RC|RUN|ABENDCC|ABEND)\b"), F.lit(1))).otherwise(none)
    # within a call a step is named alone, or with the name of a call
    alone = F.when(F.size("at") > 2, F.substring_index("step", ".", -1))
    has = F.col("cond").isNotNull() | F.col("guard").isNotNull()
    said = {"has": has, "bypass": F.when(F.col("cond").isNotNull(), bypass).otherwise(F.lit(False)), "alone": alone, "asked": F.concat(by_cond, by_if)}
    rows = rows.withColumns(said).select("file", "job", F.struct("at", "line", "step", "alone", (F.col("exec_kind") == "PROC").alias("calls"), "has", "bypass", "asked").alias("x"))
    # a job's steps side by side: rows of one job alone are looked at together
    jobs = rows.groupBy("file", "job").agg(F.sort_array(F.collect_list("x")).alias("s"))
    up = lambda at: F.slice(at, F.lit(1), F.size(at) - 1)
    none = F.array().cast("array<struct<line:int,step:string>>")
    start = F.struct(F.lit(None).cast("array<int>").alias("before"), F.lit(None).cast("array<int>").alias("cover"), none.alias("told"))

    def step(a: Column, x: Column) -> Column:
        """``before``: the place of the step before; ``cover``: that of the last call with a condition, or told; its steps come right behind it."""
        at, before = x["at"], a["before"]
        # the first of its job or call: the step before it lies in another one, or is the call
        first = before.isNull() | ~(F.slice(before, F.lit(1), F.size(at) - 1) == up(at)) | (F.size(before) == F.size(at) - 1)
        bare = ~x["has"] & ~F.coalesce(first, F.lit(True))
        covered = F.coalesce(F.slice(at, F.lit(1), F.size(a["cover"])) == a["cover"], F.lit(False))
        cover = F.when(covered, a["cover"]).when(x["calls"] & (x["has"] | bare), at)
        told = F.when(bare & ~covered, F.concat(a["told"], F.array(F.struct(x["line"].alias("line"), x["step"].alias("step"))))).otherwise(a["told"])
        return F.struct(at.alias("before"), cover.alias("cover"), told.alias("told"))

    missed = lambda x, i: F.filter(x["asked"], lambda n: ~F.exists(F.slice("s", F.lit(1), i), lambda y: (y["step"] == n) | F.coalesce(y["alone"] == n, F.lit(False))))
    missing = F.transform("s", lambda x, i: F.struct(x["line"].alias("line"), F.when(F.size(x["asked"]) > 0, F.get(missed(x, i), F.lit(0))).alias("name")))
    told = jobs.select("file", F.aggregate("s", start, step, lambda a: a["told"]).alias("told"), F.element_at("s", -1).alias("last"), F.size("s").alias("n"), F.filter(missing, lambda x: x["name"].isNotNull()).alias("missing"))
    names = F.transform("told", lambda x: x["step"])
    names = F.concat(F.array_join(F.slice(names, 1, 5), ", "), F.when(F.size("told") > 5, F.concat(F.lit(" and "), F.size("told") - 5, F.lit(" more"))).otherwise(""))
    shape = lambda rule, level, line, *text: F.struct(F.lit(rule).alias("rule_id"), F.lit(level).alias("level"), line.alias("line"), F.concat(*text).alias("message"))
    bare = F.when(F.size("told") > 0, shape("R030", "warning", F.get("told", F.lit(0))["line"], F.lit("steps run whatever the steps before returned: "), names))
    skipped = F.when((F.col("n") >= 2) & F.col("last.bypass"), shape("R046", "warning", F.col("last.line"), F.lit("last step is skipped when all goes well: "), F.coalesce("last.step", F.lit(""))))
    lost = F.transform("missing", lambda x: shape("R047", "error", x["line"], F.lit("no earlier step is called "), x["name"]))
    found = told.select("file", F.explode(F.concat(F.array_compact(F.array(bare, skipped)), lost)).alias("f"))
    return found.select("f.rule_id", "f.level", "file", "f.line", "f.message").distinct()


def ims_rules(segments: DataFrame, sensegs: DataFrame) -> DataFrame:
    known = segments.select("dbd", "segment", F.col("parent").alias("own_parent"), F.lit(True).alias("there"))
    bases = segments.select("dbd").distinct()
    met = sensegs.join(bases, "dbd", "left_semi").join(known, ["dbd", "segment"], "left")
    return finding(met.filter("there is null or not (parent <=> own_parent)"), "R090", "error", "segment is not in its data base under that parent: ", F.col("segment"))


def sql_rules(stmts: DataFrame) -> DataFrame:
    """``stmts(file, line, text)``."""
    s = stmts.withColumns({"t": C.blanked(F.col("text")), "kind": C.statement_kind(F.col("text"))}).withColumn("own", C.outermost(F.col("t")))
    t, kind, own = F.col("t"), F.col("kind"), F.col("own")  # own: clauses of the statement itself, without subqueries
    query = kind.isin("SELECT", "SELECT_INTO", "DECLARE_CURSOR", "INSERT")
    where = own.rlike(r"\bWHERE\b")
    sources = F.regexp_extract("own", r"\bFROM (.*?)( WHERE | GROUP | ORDER | FETCH |$)", 1)
    aggregate = F.regexp_extract("own", r"^SELECT (.*?) (INTO|FROM) ", 1).rlike(r"^(COUNT|SUM|MIN|MAX|AVG)\b")
    rules = (
        ("S001", "warning", query & t.rlike(r"\bSELECT (DISTINCT )?([A-Z0-9_]+\.)?\*"), "SELECT * takes columns that are added later"),
        ("S002", "error", F.col("text").rlike(r"(?i)\bLIKE\s+'%") | t.rlike(r"\b(WHERE|AND|OR) (SUBSTR|UPPER|LOWER|YEAR|MONTH|DAY|DATE|CHAR|TRIM|VALUE|COALESCE)\([^)]*\) ?(=|<|>|LIKE)"), "predicate that no index narrows"),
        ("S004", "warning", (kind == "DECLARE_CURSOR") & ~own.rlike(r"\bFOR (UPDATE|READ ONLY|FETCH ONLY)\b"), "cursor says neither FOR UPDATE nor FOR READ ONLY"),
        ("S007", "warning", t.rlike(r"\bUNION\b(?! ALL\b)"), "UNION sorts where UNION ALL would do"),
        ("R054", "error", kind.isin("UPDATE", "DELETE") & ~where, "all rows are written"),
        ("R056", "warning", (kind == "SELECT_INTO") & ~where & ~own.rlike(r"\bFETCH FIRST\b|\bSYSDUMMY1\b") & ~aggregate, "nothing narrows SELECT INTO to one row"),
        ("R059", "note", (kind == "INSERT") & ~t.rlike(r"^INSERT INTO \S+ ?\("), "INSERT names no columns"),
        ("R079", "warning", (kind == "LOCK_TABLE") & t.contains("EXCLUSIVE"), "table is locked for all others"),
        ("R080", "error", query & ~where & sources.contains(",") & ~own.rlike(r"\b(JOIN|ON)\b"), "tables with nothing to join them"),
        ("R081", "warning", own.rlike(r"\bFETCH FIRST\b") & ~own.rlike(r"\bORDER BY\b") & ~aggregate, "rows of FETCH FIRST have no order"),
        ("R082", "warning", t.rlike(r"\bNOT IN ?\( ?SELECT\b"), "one NULL in the subquery selects nothing"),
        ("R083", "error", t.rlike(r"^GRANT .+ TO (.*, ?)?PUBLIC\b"), "granted to everyone"),
        ("R084", "warning", t.rlike(r"^CREATE TABLE \S+ ?\(") & ~t.rlike(r"\) ?IN \S+"), "table space is left to the system"),
    )
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(lv).alias("level"), F.lit(m).alias("message"))) for r, lv, c, m in rules)))
    found = s.select("file", "line", F.explode(hits).alias("f"))
    return found.select("f.rule_id", "f.level", "file", "line", "f.message")


def utility_rules(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """R064 and R068, from the facts of ``jcl`` and the cards."""
    lacks = finding(cards.missing_dds(steps, dds), "R064", "error", "DDs that the utility opens are missing: ", F.col("missing"))
    used = dds.filter("dsn is not null and opens").join(cards.dd_roles(steps, dds), ["file", "step_no", "dd"])
    movers = steps.filter(F.col("target").isin(*cards.SORTS, *cards.COPIERS)).select("file", "step_no", F.col("line").alias("at"))
    both = used.join(movers, ["file", "step_no"]).groupBy("file", "step_no", "dsn").agg(F.max(F.col("access") == "READ").alias("r"), F.max(F.col("access") == "WRITE").alias("w"), F.min("line").alias("line"))
    return lacks.union(finding(both.filter("r and w"), "R068", "error", "input and output are the same data set: ", F.col("dsn")))


def program_rules(steps: DataFrame, dds: DataFrame, programs: DataFrame, selects: DataFrame, opens: DataFrame) -> DataFrame:
    """R048, R052 and R071: steps against the programs they run.

    ``programs(name)``, ``selects(program, dd, path, line)`` of FILE-CONTROL, ``opens(program, dd, mode)``.
    """
    known = programs.select(F.upper("name").alias("target")).distinct()
    # a program of the estate runs another name of no source: only names of its own style can be judged
    run = steps.filter("exec_kind = 'PGM'").select("file", "line", "job", "step_no", "step", "target")
    system = (*cards.REQUIRED, *cards.SQL_RUNNERS, *cards.IMS_CONTROLLERS, "IEFBR14")
    unknown = run.filter(~F.col("target").isin(*system)).join(known, "target", "left_anti")
    out = finding(unknown, "R048", "warning", "no source of the program: ", F.col("target"))
    needs = run.join(selects.select(F.upper("program").alias("target"), F.upper("dd").alias("dd"), "path", F.col("line").alias("at")), "target")
    lacks = needs.join(dds.filter("opens").select("file", "step_no", "dd"), ["file", "step_no", "dd"], "left_anti")
    per = lacks.groupBy(F.col("path").alias("file"), F.col("at").alias("line"), "dd").agg(F.array_join(F.array_sort(F.collect_set(F.concat("job", F.lit("."), "step"))), ", ").alias("steps"))
    out = out.union(finding(per, "R052", "error", "steps without the DD ", F.col("dd"), ": ", F.col("steps")))
    shared = dds.filter("opens").filter(C.disposition(F.coalesce("disp_text", F.lit("")))["status"] == "SHR").select("file", "line", "step_no", "dd")
    writes = opens.filter(F.upper("mode").isin("OUTPUT", "EXTEND")).select(F.upper("program").alias("target"), F.upper("dd").alias("dd")).distinct()
    return out.union(finding(shared.join(run.select("file", "step_no", "target"), ["file", "step_no"]).join(writes, ["target", "dd"]), "R071", "warning", "written under DISP=SHR: ", F.col("dd")))
