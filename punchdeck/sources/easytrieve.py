"""Easytrieve sources as statements, their macros expanded, each placed in its activity, procedure and report.

A line is cut into words by one expression; where a statement ends, and what it belongs to, is told by windows over a
program's rows. A level of macros is a round: calls are joined with bodies by name, the bodies' lines take the call's values
and are read like any others. A statement keeps its place as an array of numbers, one for each level.

A program has one row of the sources; a null text is an empty one. Macros that a source brings along (MSTART to MEND) are
known from there on and go before members of the library; those inside a member's text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.operators.graph import cut, dealt

#: Levels of macros; what lies deeper counts as not found.
DEPTH = 10

# Words of the language.
ACTIVITIES = ("JOB", "SORT", "PROGRAM", "SCREEN")
FIELD_TYPES = ("A", "N", "P", "B", "U", "K", "M", "I")
OPENERS, CLOSERS, BRANCHES = ("IF", "DO", "CASE"), ("END-IF", "END-DO", "END-CASE"), ("ELSE", "ELSE-IF", "ELSEIF", "WHEN", "OTHERWISE")

COMPARING = "=<>¬^!"
BREAKING = rf"\s,()*/+\-{COMPARING}"
_PART = rf"'(?:[^']|'')*+'?|[^'.{BREAKING}]|\.(?!\s|\z)"
#: A word (a hyphen before another character is its own, a sign before digits begins it), a sign, the full stop that ends a statement
#: with a comment behind it, or blanks.
TOKEN = rf"((?:{_PART}|(?<![^{BREAKING}])[+-](?=[0-9]))(?:{_PART}|-(?=[^\s,()']))*|[{COMPARING}]+|\.(?:\s+\*.*)?|[()*/+\-]|[\s,]+)"


def is_number(word: Column) -> Column:
    return F.coalesce(word.rlike(r"^[0-9]{1,9}$"), F.lit(False))


def behind(words: Column, word: str | Column, by: int = 1) -> Column:
    """The word ``by`` places behind the first ``word``; null if there is none."""
    at = F.array_position(words, word).cast("int")
    return F.when(at > 0, F.get(words, at - 1 + by))


def _words(line: Column) -> Column:
    says = F.filter(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(1)), lambda x: ~x.rlike(r"^[\s,]+$"))
    return F.transform(says, _upper)


def _upper(token: Column) -> Column:
    return F.when(F.contains(token, F.lit("'")), token).otherwise(F.upper(token))


def lines(sources: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(program, line, raw)``: the lines of each source, from 1."""
    rows = dealt(sources.select(F.col(id_column).alias("program"), F.coalesce(text_column, F.lit("")).alias("text")), "program")
    return rows.select("program", F.posexplode(F.split("text", "\r\n|\r|\n|\x85", -1)).alias("line", "raw")).withColumn("line", F.col("line") + 1)


def _marked(rows: DataFrame, key: list[str]) -> DataFrame:
    """Lines with what they are: ``macro`` the line of the MSTART whose body they stand in, ``data`` whether they are no statements:
    bodies of macros, and rows of a table behind its fields ARG and DESC."""
    body = F.upper(F.regexp_replace(F.substring("raw", 1, 72), r"^\s+|\s+$", ""))
    first = F.regexp_replace(F.regexp_extract(body, r"^(\S*)", 1), r"\.$", "")
    field = F.when(first == "DEFINE", F.regexp_extract(body, r"^DEFINE\s+(\S+)", 1)).otherwise(first)
    rows = rows.withColumns({"first": first, "field": field, "instream": body.rlike(r"\bINSTREAM\b") & ~body.startswith("*")})
    w = Window.partitionBy(*key).orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("stretch", F.count_if(F.col("first") == "MEND").over(before))
    rows = rows.withColumn("macro", F.min(F.when(F.col("first") == "MSTART", F.col("line"))).over(Window.partitionBy(*key, "stretch")))
    rows = rows.withColumn("macro", F.when(F.col("line") >= F.col("macro"), F.col("macro")))
    opens = (F.col("first") == "FILE") & F.col("macro").isNull()
    rows = rows.withColumn("opened", F.count_if(opens).over(w))
    inside = Window.partitionBy(*key, "opened").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.bool_or(c).over(inside), F.lit(False))
    table = (F.col("opened") > 0) & seen(F.col("instream")) & seen(F.col("field") == "ARG") & seen(F.col("field") == "DESC") & ~seen(F.col("first") == "ENDTABLE")
    return rows.withColumn("data", F.col("macro").isNotNull() | table).drop("field", "instream", "stretch", "opened")


def own_macros(rows: DataFrame) -> DataFrame:
    """``(program, name, since, body)`` of macros between MSTART and MEND of ``lines``; ``body`` holds ``(line, raw)`` in order."""
    rows = _marked(rows, ["program"]).filter("macro is not null and (line = macro or first <> 'MEND')")
    name = F.upper(F.regexp_extract("raw", r"(?i)^\s*MSTART[\s,]+([^\s,]+?)\.?(?:[\s,].*)?$", 1))
    found = rows.groupBy("program", F.col("macro").alias("since")).agg(
        F.max(F.when(F.col("line") == F.col("macro"), name)).alias("name"), F.sort_array(F.collect_list(F.when(F.col("line") > F.col("macro"), F.struct("line", "raw")))).alias("body"))
    return found.filter("name <> ''").select("program", "name", "since", "body")


def segmented(rows: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, nth, line, end_line, words, text)``: statements of ``(*key, line, raw)``, from 1.

    A statement ends with its line, unless that ends in a lone ``+`` or ``-``; at a full stop before a blank; at a blank line. Comment
    lines end none. Words are in upper case unless they hold a literal.
    """
    # comments tell nothing of the lines around them: they go before the windows sort what is left
    rows = _marked(rows.filter(~F.substring("raw", 1, 72).rlike(r"^\s*\*")), key).filter("not data")
    area = F.regexp_replace(F.substring("raw", 1, 72), r"\s+$", "")
    rows = rows.select(*key, "line", area.alias("area"))
    goes_on = F.col("area").rlike(r"(?:^|\s)[+-]$")
    said = F.when(goes_on, F.regexp_replace("area", r"\s*[+-]$", "")).otherwise(F.col("area"))
    parts = F.concat(F.array(F.lit("\n")), F.regexp_extract_all(said, F.lit(TOKEN), F.lit(1)), F.when(goes_on, F.array().cast("array<string>")).otherwise(F.array(F.lit("."))))
    rows = rows.select(*key, "line", F.posexplode(parts).alias("pos", "token"))
    before = Window.partitionBy(*key).orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"ends": F.col("token").rlike(r"^\.(?:\s|\z)"), "says": ~F.col("token").rlike(r"^[\s,]+$")})
    rows = rows.withColumn("piece", F.count_if("ends").over(before)).filter("not ends")
    ordered = F.sort_array(F.collect_list(F.struct("line", "pos", "token", "says")))
    found = rows.groupBy(*key, "piece").agg(ordered.alias("parts"), F.min(F.when(F.col("says"), F.col("line"))).alias("line"), F.max(F.when(F.col("says"), F.col("line"))).alias("end_line")).filter("line is not null")
    words = F.transform(F.filter("parts", lambda x: x["says"]), lambda x: _upper(x["token"]))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["token"]), ""), r"\s*\n\s*", " "))
    return found.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("piece")).alias("nth"), "line", "end_line", words.alias("words"), text.alias("text"))


def library(members: DataFrame, path_column: str, text_column: str) -> DataFrame:
    """``(folder, name, member, body)`` of macro members, the first by path of each name and folder; ``folder`` null for the first of all."""
    path = F.regexp_replace(path_column, r"\\", "/")
    name = F.upper(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))
    body = F.transform(F.split(F.coalesce(text_column, F.lit("")), "\r\n|\r|\n|\x85", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("raw")))
    rows = members.filter(F.col(path_column).isNotNull()).select(F.regexp_extract(path, r"^(.*?)[^/]*$", 1).alias("folder"), name.alias("name"), F.col(path_column).alias("member"), body.alias("body"))
    first = lambda key: F.min_by(F.struct("member", "body"), "member").alias("x")  # noqa: E731, ARG005
    near = rows.groupBy("folder", "name").agg(first("near")).select("folder", "name", "x.*")
    return near.union(rows.groupBy("name").agg(first("all")).select(F.lit(None).cast("string"), "name", "x.*"))


def _described(rows: DataFrame) -> DataFrame:
    """``rows`` with ``macro``: the body's ``lines`` behind the prototype, and the ``listed`` parameters of that, the first ``n`` of them positional;
    ``listed`` is null if the first line that is no comment isn't MACRO. Told once for a macro, not for each call."""
    rows = rows.withColumn("head", F.get(F.filter("body", lambda x: ~x["raw"].rlike(r"^\s*(?:\*|$)")), 0))
    rows = rows.withColumn("says", F.when(F.col("head.raw").rlike(r"(?i)^\s*MACRO(?:\s|$)"), _words(F.regexp_replace(F.substring("head.raw", 1, 72), r"(?:\s+[+-])?\s*$", ""))))
    stop = F.array_position("says", ".").cast("int")
    rows = rows.withColumn("names", F.slice(F.when(stop > 0, F.slice("says", F.lit(1), stop - 1)).otherwise(F.col("says")), 2, 10000))
    counted = is_number(F.get("names", F.lit(0)))
    rows = rows.withColumn("listed", F.when(counted, F.slice("names", 2, 10000)).otherwise(F.col("names")))
    n = F.when(counted, F.least(F.get("names", F.lit(0)).try_cast("int"), F.size("listed"))).otherwise(F.size("listed"))
    below = F.when(F.col("listed").isNull(), F.col("body")).otherwise(F.filter("body", lambda x: x["line"] > F.col("head.line")))
    return rows.withColumn("macro", F.struct(below.alias("lines"), "listed", n.alias("n"))).drop("head", "says", "names", "listed")


def _record(**parts: Column) -> Column:
    """A struct by names that hold inside of functions over arrays, where aliases may be lost."""
    return F.named_struct(*[x for k, v in parts.items() for x in (F.lit(k), v)])


def _grouped(words: Column) -> Column:
    """Arguments of a call: words, and what stands in brackets as one."""
    start = _record(level=F.lit(0), held=F.array().cast("array<string>"), out=F.array().cast("array<string>"))

    def step(a: Column, w: Column) -> Column:
        level = a["level"] + F.when(w == "(", 1).when((w == ")") & (a["level"] > 0), -1).otherwise(0)
        closes, opens = (w == ")") & (a["level"] == 1), (w == "(") & (a["level"] == 0)
        held = F.when(closes | opens, F.array().cast("array<string>")).when(a["level"] > 0, F.concat(a["held"], F.array(w))).otherwise(a["held"])
        out = F.when(closes, F.concat(a["out"], F.array(F.array_join(a["held"], " ")))).when((a["level"] == 0) & ~opens, F.concat(a["out"], F.array(w))).otherwise(a["out"])
        return _record(level=level, held=held, out=out)

    return F.aggregate(words, start, step, lambda a: a["out"])


def _valued(calls: DataFrame) -> DataFrame:
    """``calls`` with ``values``: pairs of the macro's parameters, longest names first - positional ones in order, keyword ones by name or as the
    prototype says. A step for a column: what a function over an array holds is computed for each of its elements."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    listed, n = F.col("macro.listed"), F.col("macro.n")
    shown = F.transform(listed, lambda x, i: _record(k=x, v=F.when(i < n, F.lit("")).otherwise(F.get(listed, i + 1)), at=i))
    calls = calls.withColumn("given", F.filter(shown, lambda x: ((x["at"] < n) | ((x["at"] - n) % 2 == 0)) & x["v"].isNotNull()))
    calls = calls.withColumns({"keywords": F.transform(F.filter("given", lambda x: x["at"] >= n), lambda x: x["k"]), "arguments": _grouped(F.slice("words", 2, 10000))})
    start = _record(keyword=F.lit(None).cast("string"), at=F.lit(0), out=none)

    def step(a: Column, x: Column) -> Column:
        named = F.array_contains("keywords", x["w"]) & x["more"]
        valued, opens, placed = a["keyword"].isNotNull(), a["keyword"].isNull() & named, a["keyword"].isNull() & ~named & (a["at"] < n)
        key = F.when(valued, a["keyword"]).when(placed, F.get(listed, a["at"]))
        return _record(keyword=F.when(opens, x["w"]), at=a["at"] + placed.cast("int"), out=F.when(key.isNotNull(), F.concat(a["out"], F.array(_record(k=key, v=x["w"])))).otherwise(a["out"]))

    calls = calls.withColumn("told", F.aggregate(F.transform("arguments", lambda w, i: _record(w=w, more=i < F.size("arguments") - 1)), start, step, lambda a: a["out"]))
    last = F.transform("given", lambda g: _record(size=-F.length(g["k"]), k=g["k"], v=F.coalesce(F.try_element_at(F.filter("told", lambda t: t["k"] == g["k"]), F.lit(-1))["v"], g["v"])))
    return calls.withColumn("values", F.sort_array(last)).drop("given", "keywords", "arguments", "told")


def _filled(raw: Column, values: Column) -> Column:
    """``&NAME`` and ``&NAME.`` replaced, in either case."""
    plain = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
    replaced = F.aggregate(values, raw, lambda a, x: F.regexp_replace(a, F.concat(F.lit(r"(?i)&\Q"), x["k"], F.lit(r"\E\.?")), plain(x["v"])))
    return F.when(F.contains(raw, F.lit("&")), replaced).otherwise(raw)


def expanded(sources: DataFrame, id_column: str, text_column: str, members: DataFrame | None = None, path_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(program, path, file, line, end_line, words, text)`` of all statements in the order of ``path``, and ``(program, path, line, file, name,
    found)`` of the macros called. ``members`` is a ``library``, ``path_column`` the sources' paths, whose folder's members go first; ``file``
    is null in the source itself. A macro inside itself and one over ``DEPTH`` levels down count as not found.
    """
    spark = sources.sparkSession
    rows = lines(sources, id_column, text_column)
    # few sources bring macros along: only their lines are read for them
    bring = lines(sources.filter(F.contains(F.upper(text_column), F.lit("MSTART"))), id_column, text_column)
    own = cut(_described(own_macros(bring)).select("program", "name", "since", "macro"))
    if members is None:
        members = spark.createDataFrame([], "folder string, name string, member string, body array<struct<line:int,raw:string>>")
    members = cut(_described(members).select("folder", "name", "member", "macro"))
    folders = sources.select(F.col(id_column).alias("program"), F.regexp_extract(F.regexp_replace(path_column, r"\\", "/") if path_column else F.lit(""), r"^(.*?)[^/]*$", 1).alias("near"))
    front = segmented(rows, ["program"]).select("program", F.array("nth").alias("path"), F.lit(None).cast("string").alias("file"), "line", "end_line", "words", "text", F.array().cast("array<string>").alias("chain"), F.col("line").alias("top"))
    out, uses = [], []
    while True:
        front = cut(front)
        called = F.col("words")[0].rlike("^%.")
        out.append(front.filter(~called).drop("chain", "top"))
        calls = front.filter(called).withColumn("name", F.substring(F.col("words")[0], 2, 1000))
        if calls.isEmpty():
            break
        # the source's own macro of that name, the last one before the call
        mine = calls.join(own, ["program", "name"]).filter("since < top").groupBy("program", "path").agg(F.max_by("macro", "since").alias("own"))
        met = calls.join(mine, ["program", "path"], "left").join(folders, "program", "left")
        near = members.filter("folder is not null").select(F.col("folder").alias("near"), "name", F.struct("member", "macro").alias("beside"))
        met = met.join(near, ["near", "name"], "left").join(members.filter("folder is null").select("name", F.struct("member", "macro").alias("any")), "name", "left")
        body = F.coalesce("own", "beside.macro", "any.macro")
        within = F.when(F.col("own").isNull(), F.coalesce("beside.member", "any.member"))
        found = body.isNotNull() & ~F.array_contains("chain", F.col("name")) & (F.size("chain") < DEPTH)
        met = cut(met.select("program", "path", "file", "line", "name", "words", "top", "chain", found.alias("found"), F.when(found, body).alias("macro"), within.alias("within")))
        uses.append(met.select("program", "path", "line", "file", "name", "found"))
        taken = _valued(met.filter("found"))
        taken = taken.select("program", "path", "within", "top", F.concat("chain", F.array("name")).alias("chain"), "values", F.explode("macro.lines").alias("x"))
        raw = F.when(F.col("values").isNull(), F.col("x.raw")).otherwise(_filled(F.col("x.raw"), F.col("values")))
        key = ["program", "path", "within", "top", "chain"]
        read = segmented(taken.select(*key, F.col("x.line").alias("line"), raw.alias("raw")), key)
        front = read.select("program", F.concat("path", F.array("nth")).alias("path"), F.col("within").alias("file"), "line", "end_line", "words", "text", "chain", "top")
    rows, none = out[0], spark.createDataFrame([], "program string, path array<int>, line int, file string, name string, found boolean")
    for more in out[1:]:
        rows = rows.union(more)
    told = uses[0] if uses else none.withColumn("program", F.col("program").cast(sources.schema[id_column].dataType))
    for more in uses[1:]:
        told = told.union(more)
    return rows, told


def placed(statements: DataFrame) -> DataFrame:
    """``(program, n, file, line, end_line, words, text, keyword, role, activity, proc, proc_n, report_n, depth)``.

    ``role`` is library, activity, report, proc (their first statements) or statement; ``activity`` is 0 before the first, ``proc`` and
    ``report_n`` tell what the statement stands in, ``depth`` how many IF, DO and CASE are open around it.
    """
    w = Window.partitionBy("program").orderBy("path")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    key = F.col("keyword")
    rows = statements.withColumns({"keyword": F.col("words")[0], "n": F.row_number().over(w)})
    head = (F.size("words") == 1) & (F.lead(key).over(w) == "PROC") & ~key.isin("PROC", "STOP", "END-PROC", *CLOSERS, *BRANCHES)
    rows = rows.withColumn("head", F.coalesce(head, F.lit(False)))
    rows = rows.withColumn("in_proc", F.coalesce(F.last(F.when(F.col("head"), F.struct("n", "keyword")).when(key == "END-PROC", F.struct(F.lit(0).alias("n"), F.lit("").alias("keyword"))), ignorenulls=True).over(w), F.struct(F.lit(0).alias("n"), F.lit("").alias("keyword"))))
    rows = rows.withColumns({"proc_n": F.col("in_proc.n"), "proc": F.nullif("in_proc.keyword", F.lit(""))})
    at = lambda k: F.get("words", F.lit(k))
    field = (is_number(at(1)) | at(1).isin("*", "W", "S")) & is_number(at(2)) & F.coalesce(at(3).isin(*FIELD_TYPES), F.lit(False))
    opens = key.isin(*ACTIVITIES) & (F.col("proc_n") == 0)
    rows = rows.withColumns({"may": opens, "sure": opens & ~F.coalesce(field, F.lit(False))})
    rows = rows.withColumn("opens", F.col("sure") | (F.col("may") & F.coalesce(F.bool_or("sure").over(before), F.lit(False))))
    rows = rows.withColumn("activity", F.count_if("opens").over(w).cast("int"))
    report = (key == "REPORT") & (F.col("activity") > 0) & (F.col("proc_n") == 0)
    rows = rows.withColumn("report_n", F.coalesce(F.last(F.when(report, F.col("n")).when(F.col("opens"), 0), ignorenulls=True).over(w), F.lit(0)))
    role = F.when(F.col("opens"), "activity").when(report, "report").when(F.col("head"), "proc").when(F.col("activity") == 0, "library").otherwise("statement")
    dropped = key.isin("MSTART", "MEND", "END-PROC") | ((key == "PROC") & F.coalesce(F.lag("head").over(w), F.lit(False)))
    rows = rows.withColumns({"role": role, "dropped": dropped}).filter("not dropped")
    inside = Window.partitionBy("program", "activity", "report_n", "proc_n").orderBy("n")
    executes = F.col("role") == "statement"
    rows = rows.withColumn("sum", F.sum(F.when(executes & key.isin(*OPENERS), 1).when(executes & key.isin(*CLOSERS), -1).otherwise(0)).over(inside))
    level = F.col("sum") - F.least(F.lit(0), F.min("sum").over(inside))
    rows = rows.withColumn("level", level.cast("int"))
    depth = F.when(key.isin(*OPENERS), F.col("level") - 1).when(key.isin(*BRANCHES), F.greatest(F.lit(0), F.col("level") - 1)).otherwise(F.col("level"))
    return rows.select("program", "n", "file", "line", "end_line", "words", "text", "keyword", "role", "activity", "proc", "proc_n", "report_n", F.when(executes, depth).otherwise(0).alias("depth"))


# The program that compiles and runs what its SYSIN holds.
COMPILES = ("EZTPA00",)


def under_steps(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """``(program, file, job, step, line, text)``: sources in the SYSIN of steps of ``jcl.facts``, ``program`` being FILE:JOB.STEP and ``line`` that of
    the first DD; data sets that are concatenated to it aren't read."""
    mine = steps.filter((F.col("exec_kind") == "PGM") & F.col("target").isin(*COMPILES)).select("file", "step_no")
    rows = dds.filter("dd = 'SYSIN' and size(instream) > 0").join(mine, ["file", "step_no"], "left_semi")
    text = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "instream"))), lambda x: x["instream"])), "\n")
    found = rows.groupBy("file", "step_no", "job", "step").agg(text.alias("text"), F.min("line").alias("line"))
    name = F.concat(F.col("file").cast("string"), F.lit(":"), F.concat_ws(".", "job", "step"))
    return found.select(name.alias("program"), "file", "job", "step", "line", "text")
