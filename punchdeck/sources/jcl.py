"""JCL sources to facts: one row for each statement, then steps and DDs as DataFrames.

Files are parsed one by one in ``mapInArrow``; a file is small, the number of files is not. Statements that can't
be read become rows of kind ``?`` and nothing else of the file is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "file string, line int, seq int, kind string, name string, positional string, parameters map<string,string>, instream array<string>"
STATEMENT = re.compile(r"^//(\S*)\s+(\S+)(?:\s+(.*))?$")
KEYED = re.compile(r"^[A-Z0-9.$#@]+=")
#: The same as Arrow has it.
ARROW = pa.schema([("file", pa.string()), ("line", pa.int32()), ("seq", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("positional", pa.string()), ("parameters", pa.map_(pa.string(), pa.string())), ("instream", pa.list_(pa.string()))])


def operands(text: str) -> list[str]:
    """Split at commas outside of quotes and brackets; the field ends at a blank outside of quotes."""
    if "'" not in text:
        text = text.split(" ", 1)[0]
        if "(" not in text and ")" not in text:
            return text.split(",")
    out, part, depth, quoted = [], "", 0, False
    for c in text:
        if c == "'":
            quoted = not quoted
        elif not quoted and c == " ":
            break
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        if c == "," and not quoted and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def statements(text: str) -> list[dict]:
    """Statements with their continuations joined and in-stream lines attached."""
    out: list[dict] = []
    rows, at = text.split("\n"), 0
    while at < len(rows):
        raw, start = rows[at][:71].rstrip(), at
        at += 1
        if not raw.startswith("//") or raw.startswith("//*") or raw == "//":
            continue
        found = STATEMENT.match(raw)
        if not found:
            out.append({"line": start + 1, "kind": "?", "name": raw[2:10].strip(), "positional": None, "parameters": {}, "instream": []})
            continue
        name, verb, field = found[1], found[2].upper(), found[3] or ""
        if verb == "IF":
            # its condition is no list of operands: all up to THEN, on as many lines as it takes
            while not re.search(r"\bTHEN\b", field.upper()) and at < len(rows) and rows[at].startswith("// "):
                field += " " + rows[at][2:71].strip()
                at += 1
            condition = re.split(r"\s*\bTHEN\b", field, flags=re.IGNORECASE)[0].strip()
            out.append({"line": start + 1, "kind": verb, "name": name, "positional": condition or None, "parameters": {}, "instream": []})
            continue
        parts = operands(field)
        while parts[-1] == "" and len(parts) > 1 and at < len(rows) and rows[at].startswith("// "):
            parts = parts[:-1] + operands(rows[at][2:71].strip())
            at += 1
        position, keyed = [], {}
        for p in parts:
            if KEYED.match(p):
                k, keyed[k] = p.split("=", 1)
            elif p:
                position.append(p)
        lines: list[str] = []
        if verb == "DD" and position and position[0] in ("*", "DATA"):
            stop = keyed.get("DLM", "/*").strip("'")
            while at < len(rows) and not rows[at].startswith(stop) and not (position[0] == "*" and rows[at].startswith("//")):
                lines.append(rows[at])
                at += 1
        out.append({"line": start + 1, "kind": verb, "name": name, "positional": ",".join(position) or None, "parameters": keyed, "instream": lines})
    return out


def parse(sources: DataFrame) -> DataFrame:
    """``sources(path, text)`` to statement rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (path, s["line"], seq, s["kind"], s["name"], s["positional"], list(s["parameters"].items()), s["instream"])
                for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for seq, s in enumerate(statements(text or ""))
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    return sources.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(run, SCHEMA)


#: IFs may lie in each other this deep.
NESTING = 15


def guarded(stmts: DataFrame) -> DataFrame:
    """Statements whose EXECs have a parameter ``IF``: the conditions of the IFs around them from the outermost, joined by ``&``, those of an
    ELSE with ``NOT`` before them. It goes with a step's parameters where procedures are expanded."""
    scope = Window.partitionBy("file", "job_no_").orderBy("seq")
    kind = F.col("kind")
    # a job, a procedure and a member each have their own IFs
    rows = stmts.withColumn("job_no_", F.count_if(kind.isin("JOB", "PROC", "PEND")).over(Window.partitionBy("file").orderBy("seq")))
    # what opens, turns and closes an IF up to each EXEC; folded to those that are open there
    met = F.collect_list(F.when(kind.isin("IF", "ELSE", "ENDIF"), F.struct("kind", F.coalesce("positional", F.lit("")).alias("asked")))).over(scope)
    total = rows.withColumn("met_", met)
    top = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)

    def step(a: Column, x: Column) -> Column:
        turned = F.concat(top(a), F.array(F.struct(F.lit("NOT ").alias("no"), F.element_at(a, -1)["asked"].alias("asked"))))
        return F.when(x["kind"] == "IF", F.concat(a, F.array(F.struct(F.lit("").alias("no"), x["asked"].alias("asked"))))).when(F.size(a) == 0, a).when(x["kind"] == "ENDIF", top(a)).otherwise(turned)

    open_ = F.aggregate("met_", F.array().cast("array<struct<no:string,asked:string>>"), step)
    guard = F.array_join(F.transform(F.slice(open_, 1, NESTING), lambda x: F.concat(x["no"], x["asked"])), " & ")
    total = total.withColumn("guard_", F.when((kind == "EXEC") & (F.size("met_") > 0), F.when(F.size(open_) > 0, guard)))
    own = F.when(F.col("guard_").isNotNull(), F.create_map(F.lit("IF"), F.col("guard_"))).otherwise(F.create_map().cast("map<string,string>"))
    none = F.create_map().cast("map<string,string>")
    return total.withColumn("parameters", F.map_concat(F.map_filter(F.coalesce("parameters", none), lambda k, _: k != "IF"), own)).select(*stmts.columns)


def facts(stmts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, steps, dds). A step belongs to the job before it, a DD to the step before it in its job, or to step 0 of the job."""
    w = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    p: Column = F.col("parameters")
    named = F.when(F.col("name") != "", F.upper("name"))
    rows = stmts.withColumns({
        "job": F.last(F.when(F.col("kind") == "JOB", F.upper("name")), ignorenulls=True).over(w),
        "step_no": F.sum((F.col("kind") == "EXEC").cast("int")).over(w),
        "step": F.last(F.when(F.col("kind") == "EXEC", F.upper("name")), ignorenulls=True).over(w),
        "opened": F.last(F.when(F.col("kind").isin("JOB", "EXEC"), F.col("kind")), ignorenulls=True).over(w),
    })
    within = F.col("opened") == "EXEC"
    rows = rows.withColumns({"step_no": F.when(within, F.col("step_no")).otherwise(0), "step": F.when(within, F.col("step"))})
    jobs = rows.filter("kind = 'JOB'").select("file", "line", "job", "parameters")
    steps = rows.filter("kind = 'EXEC'").select(
        "file", "line", "job", "step_no", "step", F.when(p["PGM"].isNotNull(), "PGM").otherwise("PROC").alias("exec_kind"),
        F.upper(F.coalesce(p["PGM"], p["PROC"], "positional")).alias("target"), p["COND"].alias("cond"), p["PARM"].alias("parm"), "parameters",
    )
    part = Window.partitionBy("file", "step_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    dds = rows.filter("kind = 'DD'").withColumns({"dd": F.last(named, ignorenulls=True).over(part), "opens": named.isNotNull()})
    dds = dds.select("file", "line", "seq", "job", "step_no", "step", "dd", "opens", F.coalesce(p["DSN"], p["DSNAME"]).alias("dsn"), p["DISP"].alias("disp_text"), "positional", "parameters", "instream")
    return jobs, steps, dds
