"""Facts and findings of Easytrieve programs, from statements as ``sources.easytrieve.placed`` gives them.

Files, fields, inputs of activities, what is done with a file, and defects, all as windows and joins within programs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.operators.graph import cut
from punchdeck.sources.easytrieve import FIELD_TYPES, behind, is_number

# Words of the language.
NO_FIELDS = (
    "FILE", "DEFINE", "PARM", "COPY", "SQL", "MACRO", "MSTART", "MEND", "DECLARE", "RECORD", "ELEMENT", "LOGICAL-RECORD", "IDD", "DLI", "IDMS", "ENDTABLE", "PUSH", "POP", "LIST",
    "NEWPAGE", "SKIP", "TITLE",
)
ORGANISATIONS = ("VS", "IS", "SQL", "DLI", "IDMS", "VIRTUAL", "PRINTER", "PUNCH", "CARD")
FORMATS = ("F", "V", "U", "FB", "VB", "VBS", "FBA", "VBA", "FBM", "VBM")
USES = {"GET": "READ", "READ": "READ", "POINT": "READ", "SEARCH": "READ", "PUT": "WRITE", "WRITE": "UPDATE", "DISPLAY": "WRITE"}
REPORT_PROCEDURES = ("REPORT-INPUT", "BEFORE-LINE", "AFTER-LINE", "BEFORE-BREAK", "AFTER-BREAK", "ENDPAGE", "TERMINATION")
UNTESTED_SQL = ("DECLARE", "INCLUDE", "WHENEVER")
NO_DD = ("SQL", "DLI", "IDMS", "VIRTUAL")


def _word(k: int) -> Column:
    return F.get("words", F.lit(k))


def _bracketed(words: Column, opening: str) -> Column:
    """Words in the brackets that follow ``opening``, inner brackets left out."""
    inside = F.regexp_extract(F.array_join(words, " "), rf"(?:^| ){opening} \( ((?:[^()]|\([^()]*\))*)", 1)
    return F.filter(F.split(inside, " "), lambda x: ~x.isin("", "(", ")"))


def executed(rows: DataFrame) -> DataFrame:
    """Statements that run: those of activities and of procedures, not what describes a report."""
    return rows.filter("role = 'statement' and (report_n = 0 or proc_n > 0)")


def activities(rows: DataFrame) -> DataFrame:
    """``(program, activity, line, kind, name, inputs, sorted_to, words)``; ``inputs`` without the words of KEY, empty if none are named."""
    keyless = F.split(F.regexp_replace(F.array_join("words", " "), r" KEY (?:\([^()]*\)|[^ ]+)", ""), " ")
    given = F.when(behind(F.col("words"), "INPUT") == "(", _bracketed(keyless, "INPUT")).otherwise(F.array_compact(F.array(behind(F.col("words"), "INPUT"))))
    inputs = F.when(F.col("keyword") == "JOB", given).when(F.col("keyword") == "SORT", F.array_compact(F.array(_word(1)))).otherwise(F.array().cast("array<string>"))
    sorted_to = F.when(F.col("keyword") == "SORT", behind(F.col("words"), "TO"))
    return rows.filter("role = 'activity'").select("program", "activity", "file", "line", F.col("keyword").alias("kind"), behind(F.col("words"), "NAME").alias("name"), inputs.alias("inputs"), sorted_to.alias("sorted_to"), "words")


def files(rows: DataFrame) -> DataFrame:
    """``(program, file, n, first_n, organisation, format, record_length, is_table, instream, entries, tables, options, member, line)``: the last
    FILE statement of each name; ``first_n`` is the place of the first. ``member`` is the macro's member that the statement stands in."""
    words = F.slice("words", 3, 10000)
    kind = F.get(F.filter(words, lambda x: x.isin(*ORGANISATIONS)), 0)
    kind = F.when(kind == "VS", "VSAM").when(kind == "IS", "ISAM").otherwise(F.coalesce(kind, F.lit("SEQUENTIAL")))
    sized = F.try_element_at(F.filter(F.transform(words, lambda x, i: F.struct(x.alias("format"), F.get(words, i + 1).alias("next"), F.get(words, i + 2).alias("size"))), lambda x: x["format"].isin(*FORMATS) & (x["next"] == "(")), F.lit(-1))
    after = behind(words, "TABLE")
    listed = F.when(kind == "SQL", _bracketed(words, "SQL"))
    tables = F.when(F.get(listed, 0) == "SELECT", F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array().cast("array<string>")))
    found = rows.filter(F.col("role").isin("library") & (F.col("keyword") == "FILE") & (F.size("words") > 1)).select(
        "program", _word(1).alias("name"), "n", kind.alias("organisation"), sized["format"].alias("format"), F.when(is_number(sized["size"]), sized["size"].try_cast("int")).alias("record_length"),
        F.array_contains(words, "TABLE").alias("is_table"), F.coalesce(after == "INSTREAM", F.lit(False)).alias("instream"), F.when(is_number(after), after.try_cast("int")).alias("entries"),
        tables.alias("tables"), words.alias("options"), F.col("file").alias("member"), "line",
    )
    kept = found.groupBy("program", "name").agg(F.max_by(F.struct(*[c for c in found.columns if c not in ("program", "name")]), "n").alias("x"), F.min("n").alias("first_n"))
    return kept.select("program", F.col("name").alias("file"), "first_n", "x.*")


def _definitions(rows: DataFrame) -> DataFrame:
    """Statements that may define a field, with what they say; those on another field's place are not sure yet."""
    w = Window.partitionBy("program").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when((F.col("keyword") == "FILE") & (F.size("words") > 1), F.struct(_word(1).alias("file"), F.col("n"))), ignorenulls=True).over(w)
    rows = rows.withColumn("owner", F.when(F.col("activity") == 0, opened))
    library = (F.col("role") == "library") & ~F.col("keyword").isin(*NO_FIELDS)
    said = F.when(F.col("keyword") == "DEFINE", F.slice("words", 2, 10000)).when(library, F.col("words"))
    rows = rows.filter("role in ('library', 'statement')").withColumn("said", said).filter("size(said) > 1")
    rows = rows.withColumns({"name": F.get("said", F.lit(0)), "location": F.get("said", F.lit(1)), "rest": F.slice("said", 3, 10000)})
    placed = F.when(is_number(F.col("location")), "at").when(F.col("location") == "*", "next").when(F.col("location").isin("W", "S"), "working").otherwise("over")
    rows = rows.withColumn("how", placed)
    first, second = F.get("rest", F.lit(0)), F.get("rest", F.lit(1))
    spaced = F.col("how").isin("next", "over") & (first == "+") & is_number(second)
    signed = F.coalesce(first.rlike(r"^\+[0-9]{1,9}$"), F.lit(False)) & ((F.col("how") == "over") | ((F.col("how") == "next") & is_number(second)))
    offset = F.when(spaced, second.try_cast("int")).when(signed, first.try_cast("int")).otherwise(0)
    rows = rows.withColumn("offset", offset).withColumn("rest", F.when(spaced, F.slice("rest", 3, 10000)).when(signed, F.slice("rest", 2, 10000)).otherwise(F.col("rest")))
    sized = is_number(F.get("rest", F.lit(0)))
    typed = sized & F.coalesce(F.get("rest", F.lit(1)).isin(*FIELD_TYPES), F.lit(False))
    decimals = F.when(typed & is_number(F.get("rest", F.lit(2))), F.get("rest", F.lit(2)).try_cast("int")).otherwise(0)
    times = behind(F.col("rest"), "OCCURS")
    return rows.select(
        "program", "n", F.col("file").alias("member"), "line", "name", "location", "how", "offset", F.col("owner.file").alias("file"), F.col("owner.n").alias("owner_n"),
        F.when(sized, F.get("rest", F.lit(0)).try_cast("int")).alias("length"), F.when(typed, F.get("rest", F.lit(1))).otherwise("").alias("type"), decimals.alias("decimals"),
        F.when(is_number(times), times.try_cast("int")).otherwise(1).alias("occurs"), F.array_contains("rest", "VALUE").alias("has_value"),
    )


def fields(rows: DataFrame) -> DataFrame:
    """``(program, n, member, line, name, file, start, length, type, decimals, occurs, has_value, last)``; ``file`` is null for working storage.

    ``*`` goes on behind the field before it, a field's name takes that field's place: a round for each level of fields over fields.
    Fields that COPY takes from another file have the COPY's ``n``; ``*`` behind a COPY goes on where the file's own fields end.
    """
    found = _definitions(rows)
    span = F.col("length") * F.greatest(F.col("occurs"), F.lit(1))
    own = Window.partitionBy("program", "owner_n").orderBy("n")
    sure = found.filter("how <> 'over'").withColumn("span", span)
    sized = F.col("length").isNotNull() & F.col("owner_n").isNotNull()
    at = (F.col("how") == "at") & sized
    sure = sure.withColumns({"run": F.count_if(at).over(own.rowsBetween(Window.unboundedPreceding, 0)), "free": F.last(F.when(at, F.col("location").try_cast("int") + F.col("span")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    moved = F.coalesce(F.sum(F.when((F.col("how") == "next") & sized, F.col("offset") + F.col("span"))).over(Window.partitionBy("program", "owner_n", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sure = sure.withColumn("moved", moved)
    start = F.when(F.col("owner_n").isNull(), F.lit(None)).when(F.col("how") == "at", F.col("location").try_cast("int")).when(F.col("how") == "next", F.coalesce("free", F.lit(1)) + F.col("moved") + F.col("offset"))
    told = [c for c in found.columns if c not in ("how", "offset", "location", "file", "owner_n")]
    done = cut(sure.select(*told, F.when(F.col("how") != "working", F.col("file")).alias("file"), F.when(F.col("how") != "working", start).cast("int").alias("start")))
    waiting = cut(found.filter("how = 'over'").select(*told, "location", "offset"))
    while not waiting.isEmpty():
        bases = done.select("program", F.col("name").alias("key"), "n", F.struct(F.lit(True).alias("ready"), "file", "start").alias("base"))
        bases = bases.union(waiting.select("program", "name", "n", F.struct(F.lit(False).alias("ready"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("start"))))
        asks = waiting.select("program", F.col("location").alias("key"), "n", F.lit(None).cast("struct<ready:boolean,file:string,start:int>").alias("base"))
        w = Window.partitionBy("program", "key").orderBy("n", F.col("base").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
        # the field's own row stands behind its question; the latest earlier one answers
        met = bases.union(asks).withColumn("found", F.last("base", ignorenulls=True).over(w)).filter("base is null").select("program", "n", "found")
        met = cut(waiting.join(met, ["program", "n"]).filter("found is not null"))
        ready = met.filter("found.ready").select(*told, F.col("found.file").alias("file"), (F.col("found.start") + F.col("offset")).cast("int").alias("start"))
        done, waiting = cut(done.union(ready)), met.filter("not found.ready").select(*told, "location", "offset")
    w = Window.partitionBy("program").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    current = F.last(F.when((F.col("keyword") == "FILE") & (F.size("words") > 1), _word(1)), ignorenulls=True).over(w)
    copies = rows.filter("role = 'library'").withColumn("into", current).filter("keyword = 'COPY' and size(words) > 1 and into is not null").select("program", F.col("n").alias("copy_n"), "into", _word(1).alias("file"))
    copied = done.join(copies, ["program", "file"]).filter("n < copy_n and into <> file").withColumns({"n": F.col("copy_n"), "file": F.col("into")}).select(*done.columns)
    return done.union(copied).withColumn("last", F.col("start") + span - 1)


def file_uses(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``(program, file, access)`` of declared files: one access stays, different ones are UPDATE.

    A JOB without an input reads what the SORT before it gives, else the first file that is no table, printer or punch.
    """
    acts = activities(rows)
    w = Window.partitionBy("program").orderBy("activity")
    first = files.filter("not is_table and organisation not in ('PRINTER', 'PUNCH')").groupBy("program").agg(F.min_by("file", "first_n").alias("first_file"))
    acts = acts.withColumn("before", F.lag("sorted_to").over(w)).join(first, "program", "left")
    implied = F.array_compact(F.array(F.coalesce("before", "first_file")))
    read = F.when((F.col("kind") == "JOB") & (F.size("inputs") == 0), implied).otherwise(F.col("inputs"))
    uses = [acts.select("program", F.explode(read).alias("file"), F.lit("READ").alias("access")), acts.select("program", "sorted_to", F.lit("WRITE"))]
    booked = F.create_map(*[F.lit(x) for pair in USES.items() for x in pair])[F.col("keyword")]
    uses.append(executed(rows).select("program", _word(1), booked).filter(booked.isNotNull()))
    uses.append(rows.filter("role = 'report'").select("program", behind(F.col("words"), "PRINTER"), F.lit("WRITE")))
    uses.append(files.filter("is_table and not instream").select("program", "file", F.lit("READ")))
    every = uses[0]
    for more in uses[1:]:
        every = every.union(more)
    every = every.join(files.select("program", "file"), ["program", "file"], "left_semi")
    return every.groupBy("program", "file").agg(F.when(F.min("access") == F.max("access"), F.min("access")).otherwise("UPDATE").alias("access"))


def calls(rows: DataFrame) -> DataFrame:
    """``(program, line, verb, target, literal)``: CALL names a program itself, LINK and TRANSFER a literal or a field."""
    quoted = _word(1).startswith("'")
    target = F.when(quoted, F.upper(F.trim(F.replace(_word(1), F.lit("'"), F.lit(""))))).otherwise(_word(1))
    found = rows.filter("role = 'statement' and keyword in ('CALL', 'LINK', 'TRANSFER')").select("program", "line", F.col("keyword").alias("verb"), target.alias("target"), ((F.col("keyword") == "CALL") | quoted).alias("literal"))
    return found.filter("target <> ''")


def _finding(rows: DataFrame, rule: str, subject: Column) -> DataFrame:
    return rows.select("program", "member", "line", F.lit(rule).alias("rule_id"), subject.alias("subject"))


def _unchecked(rows: DataFrame, asks: Column, name: Column) -> DataFrame:
    """Statements ``asks`` after which no condition mentions ``name``: the next one, or the DO whose last statement this is."""
    run = executed(rows)
    key = ("program", "activity", F.when(F.col("proc_n") > 0, F.col("report_n")).otherwise(0), "proc_n")
    w = Window.partitionBy(*key).orderBy("n")
    opening = F.last(F.when(F.col("keyword") == "DO", F.col("words")), ignorenulls=True).over(Window.partitionBy(*key, "depth").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    run = run.withColumn("opening", F.when(F.col("keyword") == "END-DO", opening))
    run = run.withColumns({"next": F.lead("keyword").over(w), "next_words": F.lead("words").over(w), "next_opening": F.lead("opening").over(w)})
    told = (F.col("next").isin("IF", "DO", "CASE") & F.array_contains("next_words", name)) | ((F.col("next") == "END-DO") & F.array_contains("next_opening", name))
    return run.filter(asks & ~F.coalesce(told, F.lit(False))).withColumnRenamed("file", "member")


def unchecked_numbers(rows: DataFrame, files: DataFrame, fields: DataFrame) -> DataFrame:
    """R100: zoned fields of files that are read, an operand in an assignment and nowhere tested; the first assignment of each."""
    used = file_uses(rows, files).filter("access in ('READ', 'UPDATE')")
    zoned = fields.filter("type = 'N' and file is not null").join(used, ["program", "file"], "left_semi").select("program", "name").distinct()
    run = executed(rows)
    plain = lambda x: F.regexp_replace(x, "^[^:]*:", "")
    at = F.array_position("words", "NUMERIC").cast("int") - 1
    tested = run.filter(at > 0).select("program", plain(F.when(F.get("words", at - 1) == "NOT", F.get("words", at - 2)).otherwise(F.get("words", at - 1))).alias("name"))
    assigned = run.filter((F.size("words") > 2) & _word(1).isin("=", "EQ"))
    sign = lambda k: F.coalesce(F.get("words", k).isin("+", "-", "*", "/"), F.lit(False))
    places = F.filter(F.sequence(F.lit(2), F.size("words") - 1), lambda i: ((i > 2) & sign(i - 1)) | sign(i + 1))
    operands = assigned.select("program", F.col("file").alias("member"), "line", "activity", "report_n", "proc_n", "n", F.explode(F.transform(places, lambda i: plain(F.get("words", i)))).alias("name"))
    met = operands.join(zoned, ["program", "name"], "left_semi").join(tested, ["program", "name"], "left_anti")
    order = F.struct("activity", F.col("report_n") * (F.col("proc_n") > 0).cast("int"), F.col("proc_n") > 0, "n")
    return met.groupBy("program", "name").agg(F.min_by(F.struct("member", "line"), order).alias("x")).select("program", "x.*", "name")


def unallocated(files: DataFrame, uses: DataFrame, steps: DataFrame, dds: DataFrame) -> DataFrame:
    """R099 ``(program, file, line, job, step)``: used files and the steps that run the program - ``steps(job, step, program)``, ``dds(job, step, dd)`` -
    without a DD for it. A row for each step: a program may be run by very many."""
    needs = files.filter(~F.col("organisation").isin(*NO_DD) & ~F.col("instream")).join(uses.select("program", "file"), ["program", "file"], "left_semi")
    run = needs.select("program", "file", "line", F.upper(F.col("program").cast("string")).alias("key")).join(steps.select("job", "step", F.upper("program").alias("key")).distinct(), "key")
    return run.join(dds.select("job", "step", F.upper("dd").alias("file")).distinct(), ["job", "step", "file"], "left_anti").select("program", "file", "line", "job", "step")


def findings(rows: DataFrame, macros: DataFrame) -> DataFrame:
    """``(program, member, line, rule_id, subject)`` of R097, R098 and R100 to R106; ``macros`` as ``sources.easytrieve.expanded`` gives them."""
    rows = cut(rows)
    held, acts, run = cut(files(rows)), cut(activities(rows)), executed(rows)
    known = cut(fields(rows))
    ends = run.filter("keyword in ('STOP', 'TRANSFER')").select("program", "activity")
    endless = acts.filter((F.col("kind") == "JOB") & (F.size("inputs") == 1) & (F.get("inputs", F.lit(0)) == "NULL")).join(ends, ["program", "activity"], "left_anti").withColumnRenamed("file", "member")
    size = F.col("record_length") - F.when(F.col("format").startswith("V"), 4).otherwise(0)
    over = known.join(held.select("program", "file", "record_length", "format"), ["program", "file"]).filter(F.col("last") > size)
    over = over.groupBy("program", "member", "line", "file").agg(F.min_by("name", "n").alias("name"))
    get, sql = (F.col("keyword") == "GET") & (F.size("words") > 1), (F.col("keyword") == "SQL") & ~F.coalesce(_word(1).isin(*UNTESTED_SQL), F.lit(False))
    secret = F.contains(F.coalesce(behind(F.col("options"), "PASSWORD"), F.lit("")), F.lit("'"))
    user = F.array_position("words", "USERID").cast("int")
    behind_user = F.slice("words", user + 1, F.size("words"))
    closed = F.array_position(behind_user, ")").cast("int")
    literals = F.size(F.filter(F.when(closed > 0, F.slice(behind_user, F.lit(1), closed - 1)).otherwise(behind_user), lambda x: x.startswith("'")))
    parms = rows.filter("role = 'library' and keyword = 'PARM'").filter((user > 0) & (F.when(user > 0, literals) > 1)).withColumnRenamed("file", "member")
    performed = run.filter("keyword = 'PERFORM'").select("program", "activity", _word(1).alias("proc"))
    for word in ("START", "FINISH", "BEFORE"):
        performed = performed.union(acts.select("program", "activity", behind(F.col("words"), word)))
    procs = rows.filter("role = 'proc' and activity > 0 and report_n = 0").filter(~F.col("proc").isin(*REPORT_PROCEDURES))
    unused = procs.join(performed.filter("proc is not null").distinct(), ["program", "activity", "proc"], "left_anti").withColumnRenamed("file", "member")
    parts = [
        _finding(endless, "R097", F.col("kind")), _finding(over, "R098", F.col("name")), _finding(unchecked_numbers(rows, held, known), "R100", F.col("name")),
        _finding(_unchecked(rows, get, _word(1)), "R101", _word(1)), _finding(_unchecked(rows, sql, F.lit("SQLCODE")), "R102", _word(1)), _finding(held.filter(secret), "R103", F.col("file")), _finding(parms, "R103", F.lit("USERID")),
        _finding(held.filter("is_table and not instream and entries is null"), "R104", F.col("file")), _finding(unused, "R105", F.col("proc")),
        _finding(macros.filter("not found").withColumnRenamed("file", "member"), "R106", F.col("name")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out
