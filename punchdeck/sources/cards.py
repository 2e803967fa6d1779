"""Control cards of utilities and IMS regions, read from the steps and DDs of ``jcl.facts`` as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.functions import columns as C

# Programs, region types, DD names, verbs and keywords that the systems themselves define.
IMS_CONTROLLERS = ("DFSRRC00", "DFSPCC20")
IMS_REGIONS = ("DLI", "DBB", "BMP", "IFP")
SORTS = ("SORT", "ICEMAN", "SYNCSORT", "DFSORT")
COPIERS = ("IEBGENER", "IEBUPDTE", "IEBPTPCH", "IEBCOPY")
LAUNCHERS = ("IKJEFT01", "IKJEFT1A", "IKJEFT1B")
SQL_RUNNERS = ("DSNTEP2", "DSNTEP4", "DSNTIAUL", "DSNTIAD")
SORT_READ, SORT_WRITE = r"^(SORTIN(\d\d)?|SORTJNF[12])$", r"^(SORTOUT|SORTOF\d\d)$"
COPY_READ, COPY_WRITE = r"^SYSUT1$", r"^SYSUT2$"
DD_NAME = r"([A-Z0-9@#$]+)"
# What DEFINE makes, with the short forms.
OBJECTS = ("CLUSTER", "GENERATIONDATAGROUP", "GDG", "ALTERNATEINDEX", "AIX", "PATH", "ALIAS", "NONVSAM", "PAGESPACE", "USERCATALOG")
DEFINED = rf"(?i)^DEF(INE)?\s+({'|'.join(OBJECTS)})\b"
DB2_VERBS = {"LOAD": "WRITE", "UNLOAD": "READ", "REORG": "UPDATE", "RUNSTATS": "READ", "COPY": "READ", "REPORT": "READ", "CHECK": "READ", "RECOVER": "UNKNOWN", "REBUILD": "UNKNOWN", "MODIFY": "UNKNOWN", "QUIESCE": "UNKNOWN", "STOSPACE": "UNKNOWN"}
CSD_COMMANDS = "ADD|ALTER|APPEND|COPY|DEFINE|DEF|DELETE|EXTRACT|INITIALIZE|LIST|MIGRATE|PROCESS|REMOVE|SCAN|SERVICE|UPGRADE|USERDEFINE|VERIFY"
REQUIRED = {  # message, control and data DDs that a utility opens; a list holds alternatives
    "IDCAMS": ("SYSPRINT", "SYSIN"), "IEBGENER": ("SYSPRINT", "SYSUT1", "SYSUT2", "SYSIN"), "ICEGENER": ("SYSPRINT", "SYSUT1", "SYSUT2", "SYSIN"),
    "IEBCOPY": ("SYSPRINT",), "IEBCOMPR": ("SYSPRINT", "SYSUT1", "SYSUT2"), "IEBPTPCH": ("SYSPRINT", "SYSUT1", "SYSUT2", "SYSIN"), "IEBUPDTE": ("SYSPRINT", "SYSIN"),
    "ICETOOL": ("TOOLMSG", "DFSMSG", "TOOLIN"), "DSNUTILB": ("SYSPRINT", "SYSIN"), "EZTPA00": ("SYSPRINT", "SYSIN"), "DFHCSDUP": ("DFHCSD", "SYSPRINT", "SYSIN"), "ADRDSSU": ("SYSPRINT", "SYSIN"),
    **dict.fromkeys(SORTS, ("SYSOUT", "SYSIN|DFSPARM|$ORTPARM")), **dict.fromkeys(LAUNCHERS, ("SYSTSPRT", "SYSTSIN")),
}


def cards(lines: Column) -> Column:
    """In-stream lines as cards: blank lines and ``/*`` go, a line that ends with a comma goes on in the next."""
    kept = F.filter(F.transform(lines, lambda x: F.rtrim(x)), lambda x: (x != "") & ~x.startswith("/*"))
    return F.split(F.regexp_replace(F.array_join(kept, "\n"), ",\n[ ]*", ","), "\n")


def ims_runs(steps: DataFrame) -> DataFrame:
    """``(file, step_no, region, program, psb)`` of steps that run a program in an IMS region.

    The PSB is the program's name where PARM has none or an unresolved symbol; a program that is a symbol is no run.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim("parm"), r"^\((.*)\)$", "$1"), "'", "")
    at = lambda i: F.upper(F.trim(F.coalesce(F.get(F.split(bare, ","), F.lit(i)), F.lit(""))))
    rows = steps.filter(F.col("target").isin(*IMS_CONTROLLERS)).select("file", "step_no", at(0).alias("region"), at(1).alias("program"), at(2).alias("psb"))
    rows = rows.filter(F.col("region").isin(*IMS_REGIONS) & (F.col("program") != "") & ~F.col("program").contains("&"))
    return rows.withColumn("psb", F.when((F.col("psb") == "") | F.col("psb").contains("&"), F.col("program")).otherwise(F.col("psb")))


def iebcopy_roles(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """``(file, step_no, dd, access)`` that the COPY cards of SYSIN state; the last card that names a DD counts."""
    mine = steps.filter("target = 'IEBCOPY'").select("file", "step_no")
    rows = dds.filter("dd = 'SYSIN'").join(mine, ["file", "step_no"], "left_semi").select("file", "step_no", "seq", F.posexplode(cards(F.col("instream"))).alias("n", "card"))
    named = lambda word, access, k: F.transform(
        F.regexp_extract_all(F.upper("card"), F.lit(rf"\b{word}={DD_NAME}"), 1), lambda x: F.struct(x.alias("dd"), F.lit(access).alias("access"), F.lit(k).alias("k"))
    )
    rows = rows.select("file", "step_no", "seq", "n", F.explode(F.concat(named("INDD", "READ", 0), named("OUTDD", "WRITE", 1))).alias("r"))
    return rows.groupBy("file", "step_no", F.col("r.dd").alias("dd")).agg(F.max_by("r.access", F.struct("seq", "n", "r.k")).alias("access"))


def joined_cards(lines: Column, mark: str = "[-+]") -> Column:
    """Cards whose lines end with a continuation mark, which goes: the TSO and IDCAMS way."""
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("/*"))
    return F.split(F.regexp_replace(F.array_join(kept, "\n"), rf"\s*{mark}\n", " "), "\n")


def streams(steps: DataFrame, dds: DataFrame, programs: Sequence[str], control: str, read=joined_cards) -> DataFrame:
    """``(file, step_no, n, card)``: the cards under a control DD of the steps that run one of the programs; concatenated
    DDs are one stream."""
    mine = steps.filter(F.col("target").isin(*programs)).select("file", "step_no")
    rows = dds.filter(F.col("dd") == control).join(mine, ["file", "step_no"], "left_semi")
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "instream"))), lambda x: x["instream"]))  # of one step
    return rows.groupBy("file", "step_no").agg(lines.alias("lines")).select("file", "step_no", F.posexplode(read(F.col("lines"))).alias("n", "card"))


def unquoted(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "^'(.*)'$", "$1")


def operand_names(text: Column) -> Column:
    """The names of a bracketed list, else the first word."""
    text = F.trim(text)
    inside = F.split(F.regexp_extract(text, r"^\(([^)]*)\)?", 1), r"[,\s]+")
    names = F.when(text.startswith("("), inside).otherwise(F.array(F.regexp_extract(text, r"^(\S*)", 1)))
    return F.transform(F.filter(names, lambda x: x != ""), unquoted)


def keyword_values(text: Column, keyword: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{keyword})\s*\(\s*('[^']*'|[^\s)]+)"), 1), unquoted)


def _uses(rows: DataFrame, *parts: tuple[Column, Column, str]) -> DataFrame:
    """Explodes ``(condition, names, access)`` of each card."""
    said = lambda names, access: F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(access).alias("access")))
    made = [F.when(on, said(names, access)) for on, names, access in parts]
    return rows.select("file", "step_no", F.explode(F.flatten(F.filter(F.array(*made), lambda x: x.isNotNull()))).alias("u")).select("file", "step_no", "u.*")


def idcams_uses(steps: DataFrame, dds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data set uses, DD roles), both ``(file, step_no, name, access)``, of DEFINE, DELETE, ALTER, REPRO and PRINT."""
    rows, card = streams(steps, dds, ("IDCAMS",), "SYSIN"), F.col("card")
    after = lambda verb: F.regexp_extract(card, rf"(?i)^{verb}\b(.*)$", 1)
    alter, move = card.rlike(r"(?i)^ALTER\b"), card.rlike(r"(?i)^(REPRO|PRINT)\b")
    sets = _uses(
        rows, (card.rlike(DEFINED), keyword_values(card, "NAME"), "CREATE"), (card.rlike(r"(?i)^DEL(ETE)?\b"), operand_names(after("DEL(?:ETE)?")), "DELETE"),
        (alter, operand_names(after("ALTER")), "UPDATE"), (alter, keyword_values(card, "NEWNAME"), "CREATE"),
        (move, keyword_values(card, "INDATASET"), "READ"), (move, keyword_values(card, "OUTDATASET"), "WRITE"),
    )
    roles = _uses(rows, (move, F.transform(keyword_values(card, "INFILE"), F.upper), "READ"), (move, F.transform(keyword_values(card, "OUTFILE"), F.upper), "WRITE"))
    return sets, roles


def sort_roles(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """``(file, step_no, dd, access)`` that sort and ICETOOL cards state; a DD stated in two ways is updated."""
    no_comment = lambda lines: cards(F.filter(lines, lambda x: ~x.startswith("*")))
    listed = lambda c, word: F.flatten(F.transform(F.regexp_extract_all(F.upper(c), F.lit(rf"\b{word}=(\([^)]*\)|[^,\s]+)"), 1), lambda x: F.split(F.regexp_replace(x, "[() ]", ""), ",")))
    called = lambda c, word: F.flatten(F.transform(F.regexp_extract_all(F.upper(c), F.lit(rf"\b{word}\(([^)]*)\)"), 1), lambda x: F.split(F.regexp_replace(x, " ", ""), ",")))
    card = F.col("card")
    sort, tool = streams(steps, dds, SORTS, "SYSIN", no_comment), streams(steps, dds, ("ICETOOL",), "TOOLIN", no_comment)
    joins = F.upper(card).rlike(r"\bJOINKEYS\b")
    files = F.transform(F.regexp_extract_all(F.upper(card), F.lit(r"\bFILES?=(F[12])\b"), 1), lambda x: F.concat(F.lit("SORTJN"), x))
    named = F.regexp_extract_all(F.upper(card), F.lit(rf"\bF[12]={DD_NAME}"), 1)
    on = F.lit(True)
    rows = _uses(sort, (on, listed(card, "FNAMES"), "WRITE"), (joins, files, "READ"), (joins, named, "READ"))
    rows = rows.union(_uses(tool, (on, called(card, "FROM"), "READ"), (on, called(card, "TO"), "WRITE"), (on, F.transform(called(card, "USING"), lambda x: F.concat(x, F.lit("CNTL"))), "READ")))
    held = rows.filter("name <> ''").groupBy("file", "step_no", F.col("name").alias("dd")).agg(F.min("access").alias("low"), F.max("access").alias("high"))
    return held.select("file", "step_no", "dd", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("UPDATE").alias("access"))


def db2_utility_uses(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """``(file, step_no, name, access)`` of tables and table spaces that DSNUTILB's statements name. A verb counts at the
    start of a card; its statement goes on to the next."""
    bare = lambda lines: F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^((?:[^'-]|'[^']*'|-(?!-))*)--.*$", "$1"))), lambda x: (x != "") & ~x.startswith("/*"))
    rows = streams(steps, dds, ("DSNUTILB",), "SYSIN", bare)
    verb = F.upper(F.regexp_extract("card", rf"(?i)^({'|'.join(DB2_VERBS)})\b", 1))
    rows = rows.withColumn("verb", F.last(F.when(verb != "", verb), ignorenulls=True).over(Window.partitionBy("file", "step_no").orderBy("n")))
    text = rows.filter("verb is not null").withColumn("part", F.count_if(verb != "").over(Window.partitionBy("file", "step_no").orderBy("n")))
    text = text.groupBy("file", "step_no", "part", "verb").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "card"))), lambda x: x["card"]), " ").alias("text"))
    names = F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"\b(?:TABLESPACE|INDEXSPACE|TABLE)\s+([A-Z0-9@#$_]+(?:\.[A-Z0-9@#$_]+)?)"), 1))
    access = F.create_map(*(F.lit(x) for kv in DB2_VERBS.items() for x in kv))[F.col("verb")]
    return text.select("file", "step_no", F.explode(names).alias("name"), access.alias("access"))


def sql_card_statements(steps: DataFrame, dds: DataFrame, run_programs: DataFrame | None = None) -> DataFrame:
    """``(file, step_no, n, text)``: the SQL under SYSIN of the programs that run SQL from cards, whether a step names one
    or a launcher runs it (``run_programs(file, step_no, program)``)."""
    own = steps.filter(F.col("target").isin(*SQL_RUNNERS)).select("file", "step_no")
    if run_programs is not None:
        own = own.union(run_programs.filter(F.col("program").isin(*SQL_RUNNERS)).select("file", "step_no")).distinct()
    rows = dds.filter("dd = 'SYSIN'").join(own, ["file", "step_no"], "left_semi").groupBy("file", "step_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "instream"))), lambda x: x["instream"])).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.regexp_replace(x, r"^((?:[^'-]|'[^']*'|-(?!-))*)--.*$", "$1")), " ")
    parts = F.filter(F.transform(F.split(text, ";(?=(?:[^']*'[^']*')*[^']*$)"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return rows.select("file", "step_no", F.posexplode(parts).alias("n", "text"))


def tso_facts(steps: DataFrame, dds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, binds, uses) of the launchers' cards: ``(file, step_no, program, plan, parm, library, launcher)``,
    ``(file, step_no, kind, name, members, options)`` and ``(file, step_no, name, access)``.

    RUN and BIND count under the DSN command, that is up to END.
    """
    rows, card = streams(steps, dds, LAUNCHERS, "SYSTSIN"), F.col("card")
    mode = F.when(card.rlike(r"(?i)^DSN\b"), True).when(card.rlike(r"(?i)^END\b"), False)
    rows = rows.withColumn("dsn", F.coalesce(F.last(mode, ignorenulls=True).over(Window.partitionBy("file", "step_no").orderBy("n")), F.lit(False)))
    first = lambda word: F.get(keyword_values_whole(card, word), F.lit(0))
    run = r"(?i)^RUN\s+PROG(?:RAM)?\s*\(([^)]+)\)"
    dsn_runs = rows.filter("dsn").filter(card.rlike(run)).select("file", "step_no", F.upper(F.trim(F.regexp_extract(card, run, 1))).alias("program"), first("PLAN").alias("plan"), F.coalesce(first("PARMS"), first("PARM")).alias("parm"), first("LIB").alias("library"), F.lit("DSN").alias("launcher"))
    call = r"(?i)^CALL\s+'([^']*)'\s*(?:'([^']*)')?"
    said = F.trim(F.regexp_extract(card, call, 1))
    member = F.regexp_extract(said, r"^(.*)\(([^)]+)\)$", 2)
    calls = rows.filter(card.rlike(call)).select("file", "step_no", F.upper(F.when(member != "", member).otherwise(said)), F.lit(None).cast("string"), F.nullif(F.regexp_extract(card, call, 2), F.lit("")), F.when(member != "", F.regexp_extract(said, r"^(.*)\(([^)]+)\)$", 1)), F.lit("TSO"))
    bind = r"(?i)^(RE)?BIND\s+(PLAN|PACKAGE)\s*\(([^)]+)\)(.*)$"
    left = F.regexp_extract(card, bind, 4)
    options = F.filter(F.transform(F.regexp_extract_all(left, F.lit(r"([A-Za-z][A-Za-z0-9]*\s*\(\s*(?:'[^']*'|[^)]*)\))"), 1), lambda x: F.regexp_replace(x, r"\s*\(\s*", "(")), lambda x: ~x.rlike(r"(?i)^(PLAN|PACKAGE|MEMBER)\("))
    binds = rows.filter("dsn").filter(card.rlike(bind)).select(
        "file", "step_no", F.upper(F.concat(F.when(F.regexp_extract(card, bind, 1) != "", "REBIND-").otherwise(""), F.regexp_extract(card, bind, 2))).alias("kind"), F.trim(F.regexp_extract(card, bind, 3)).alias("name"),
        F.split(F.regexp_replace(F.coalesce(F.get(keyword_values_whole(left, "MEMBER"), F.lit(0)), F.lit("")), r"\s", ""), ",").alias("members"), options.alias("options"),
    )
    alloc = card.rlike(r"(?i)^ALLOC(ATE)?\b")
    word = lambda w: F.concat(F.lit(" "), F.upper(card), F.lit(" ")).contains(f" {w} ")
    access = F.when(word("NEW"), "CREATE").when(word("OLD"), "UPDATE").when(word("MOD"), "WRITE").when(word("SHR"), "READ").otherwise("UNKNOWN")
    made = rows.filter(alloc).select("file", "step_no", F.get(keyword_values_whole(card, "DA|DATASET|DSNAME"), F.lit(0)).alias("name"), access.alias("access")).filter("name is not null")
    gone = _uses(rows, (card.rlike(r"(?i)^DELETE\b"), operand_names(F.regexp_extract(card, r"(?i)^DELETE\b(.*)$", 1)), "DELETE"))
    return dsn_runs.union(calls), binds, made.union(gone)


def keyword_values_whole(text: Column, keyword: str) -> Column:
    """Values of a keyword up to its bracket, blanks included."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?<![A-Z0-9])(?:{keyword})\s*\(\s*('[^']*'|[^)]*)\)"), 1), unquoted)


def csd_definitions(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """``(file, step_no, type, name, attributes)`` of DEFINE commands; a command goes on until a line starts another."""
    whole = lambda lines: F.filter(F.transform(lines, lambda x: F.substring(x, 1, 72)), lambda x: (F.trim(x) != "") & ~x.startswith("*"))
    rows = streams(steps, dds, ("DFHCSDUP",), "SYSIN", whole)
    w = Window.partitionBy("file", "step_no").orderBy("n")
    rows = rows.withColumn("command", F.count_if(F.trim("card").rlike(rf"(?i)^({CSD_COMMANDS})\b")).over(w)).filter("command > 0")
    text = rows.groupBy("file", "step_no", "command").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "card"))), lambda x: F.trim(x["card"])), " ").alias("text"))
    key, value = (F.regexp_extract_all(F.regexp_replace("text", r"^\S+\s", ""), F.lit(r"([A-Za-z][A-Za-z0-9]*)\s*\(\s*('[^']*'|[^)]*)\)"), k) for k in (1, 2))
    pairs = F.transform(F.arrays_zip(key.alias("k"), value.alias("v")), lambda x: F.struct(F.upper(x["k"]).alias("k"), F.trim(unquoted(x["v"])).alias("v")))
    found = text.filter(F.col("text").rlike(r"(?i)^DEF(INE)?\s")).select("file", "step_no", pairs.alias("p")).filter("size(p) > 0")
    more = F.array_join(F.transform(F.slice("p", 2, 99), lambda x: F.concat(x["k"], F.lit("="), x["v"])), ",")
    return found.select("file", "step_no", F.get("p", F.lit(0))["k"].alias("type"), F.upper(F.get("p", F.lit(0))["v"]).alias("name"), more.alias("attributes")).filter("name <> ''")


def iefbr14_roles(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """``(file, step_no, dd, access)``: what the dispositions of a step that runs no code create and delete."""
    disp = C.disposition(F.col("disp_text"))
    rows = dds.filter("opens and disp_text is not null").filter(F.coalesce(F.upper("positional"), F.lit("")) != "DUMMY").join(steps.filter("target = 'IEFBR14'").select("file", "step_no"), ["file", "step_no"], "left_semi")
    access = F.when(disp["normal"] == "DELETE", "DELETE").when(disp["status"].isin("NEW", "MOD"), "CREATE")
    return rows.select("file", "step_no", "dd", access.alias("access")).filter("access is not null")


def missing_dds(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """``(file, line, step, missing)``: DDs that a utility opens and its step lacks, one row for each step. A sort with
    PARM needs no control DD."""
    needs = F.create_map(*(x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    have = dds.filter("opens").groupBy("file", "step_no").agg(F.collect_set("dd").alias("have"))  # of one step
    rows = steps.filter(F.col("target").isin(*REQUIRED)).join(have, ["file", "step_no"], "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    parm = F.col("target").isin(*SORTS) & F.col("parm").isNotNull()
    lacks = F.filter(needs[F.col("target")], lambda x: ~F.arrays_overlap(F.split(x, r"\|"), F.col("have")) & ~(parm & x.contains("SYSIN")))
    return rows.select("file", "line", "step", F.array_join(F.transform(lacks, lambda x: F.get(F.split(x, r"\|"), F.lit(0))), ", ").alias("missing")).filter("missing <> ''")


def dd_roles(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """``(file, step_no, dd, access)``: by cards, else by the DD names of sorts and copiers, else by the DD itself: SYSOUT is
    written, in-stream lines are read, NEW and MOD write, OLD updates, SHR reads.

    DUMMY DDs and those that state nothing have no row; steps of IEFBR14 have what its dispositions create and delete.
    """
    p = F.col("parameters")
    status = F.upper(F.regexp_extract(F.coalesce("disp_text", F.lit("")), r"^\(?\s*(\w+)", 1))
    sort, copier = F.col("target").isin(*SORTS), F.col("target").isin(*COPIERS)
    access = (
        F.when(sort & F.col("dd").rlike(SORT_READ) | copier & F.col("dd").rlike(COPY_READ), "READ")
        .when(sort & F.col("dd").rlike(SORT_WRITE) | copier & F.col("dd").rlike(COPY_WRITE), "WRITE")
        .when(p["SYSOUT"].isNotNull(), "WRITE").when(F.size("instream") > 0, "READ")
        .when(status.isin("NEW", "MOD"), "WRITE").when(status == "OLD", "UPDATE").when(status == "SHR", "READ")
    )
    own = steps.filter("target <> 'IEFBR14'").select("file", "step_no", "target")
    rows = dds.filter("opens").filter(F.coalesce(F.upper("positional"), F.lit("")) != "DUMMY").join(own, ["file", "step_no"])
    rows = rows.select("file", "step_no", "dd", access.alias("stated"))
    carded = iebcopy_roles(steps, dds).union(sort_roles(steps, dds)).union(idcams_uses(steps, dds)[1].groupBy("file", "step_no", F.col("name").alias("dd")).agg(F.max("access")))
    found = rows.join(carded.withColumnRenamed("access", "carded"), ["file", "step_no", "dd"], "full")
    found = found.select("file", "step_no", "dd", F.coalesce("carded", "stated").alias("access")).filter("access is not null")
    return found.union(iefbr14_roles(steps, dds))
