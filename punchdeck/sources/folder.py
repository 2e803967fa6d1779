"""Asset folders: one row for each file, with its kind, its code page and its text, all by column expressions.

Files are read by Spark's own reader, in parallel and from any file system; there is no limit of their number. The reader
leaves out empty files and names that begin with ``_`` or a dot.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punchdeck.sources.scripts import directive

# Folders and extensions that hold no sources.
EXCLUDED_FOLDERS = ("node_modules", "build", "target", "out", "dist")
EXCLUDED_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "tif", "tiff", "webp", "zip", "jar", "war", "ear", "gz", "tar", "7z", "rar",
    "exe", "dll", "so", "dylib", "class", "o", "obj", "bin", "pdf", "sarif", "html", "txt", "json", "md", "db",
)

# Extensions of each kind.
EXTENSIONS = {
    "BMS": ("bms",), "COBOL": ("cbl", "cob", "cobol"), "COPYBOOK": ("cpy", "copy"), "JCL": ("jcl",), "SQL": ("sql", "ddl", "spufi", "dml"),
    "EASYTRIEVE": ("ezt", "ezy", "ezp", "easy"), "IMS_DBD": ("dbd",), "IMS_PSB": ("psb",),
}

# Operations of JCL statements, macros of BMS, divisions of COBOL, formats of Easytrieve files.
JCL_OPERATIONS = ("JOB", "EXEC", "DD", "PROC", "PEND", "SET", "INCLUDE", "IF", "ELSE", "ENDIF", "OUTPUT", "JCLLIB", "COMMAND")
BMS_MACROS = ("DFHMSD", "DFHMDI", "DFHMDF")
DIVISIONS = ("IDENTIFICATION", "ID", "ENVIRONMENT", "DATA", "PROCEDURE")
EZT_FORMATS = ("F", "FB", "U", "V", "VB", "VBS")
# What stands behind the name of an Easytrieve FILE and behind JOB.
EZT_FILE_WORDS = (*EZT_FORMATS, "ASA", "BUFNO", "CARD", "DEFER", "DLI", "EXIT", "EXTENDED", "IDMS", "IS", "PRINTER", "PUNCH", "RETAIN", "SEQUENTIAL", "SQL", "TABLE", "VIRTUAL", "VS", "WORKAREA")
EZT_JOB_WORDS = ("ACTIVITY", "COMMIT", "ENVIRONMENT", "FINISH", "INPUT", "NAME", "START", "TERMINAL")
# First words of SQL statements.
SQL_WORDS = (
    "ALTER", "CALL", "COMMENT", "CONNECT", "CREATE", "DECLARE", "DELETE", "DROP", "EXPLAIN", "GRANT", "INSERT", "LABEL", "LOCK", "MERGE", "REFRESH", "RENAME", "REVOKE", "SELECT", "SET", "TRUNCATE", "UPDATE",
    "VALUES", "WITH",
)


def fields(line: Column) -> Column:
    """The fields between blanks; a line that begins with one has an empty first field."""
    return F.split(F.rtrim(line), r"[ \t]+")


def words(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^[ \t]+|[ \t]+$", ""), r"[ \t]+")


def leading(word: Column) -> Column:
    return F.regexp_extract(word, "^([A-Z]+)", 1)


def is_name(word: Column, most: int) -> Column:
    return (F.length(word) <= most) & word.rlike("^[A-Z@#$]")


def deciding(line: Column) -> Column:
    """The kind of a source that holds such a line, wherever it stands; null for most lines."""
    up = F.upper(line)
    f, w = fields(up), words(up)
    none = F.lit("")
    at = lambda a, i: F.coalesce(F.get(a, F.lit(i)), none)
    label, operation, operand = at(f, 0), at(f, 1), at(f, 2)
    job = up.startswith("//") & leading(operation).isin(*JCL_OPERATIONS) & ((F.length(label) == 2) | is_name(F.substring(label, 3, 99), 8))
    psb = ((operation == "PCB") & operand.startswith("TYPE=")) | (operation == "PSBGEN")
    said = F.regexp_extract_all(F.substring(up, 7, 66), F.lit("[A-Z0-9-]+"), F.lit(0))
    heads = F.exists(F.arrays_zip(said.alias("a"), F.slice(said, F.lit(2), F.size(said)).alias("b")), lambda x: x["a"].isin(*DIVISIONS) & (x["b"] == "DIVISION"))
    program = (F.length(line) > 6) & ~F.substring(line, 7, 1).isin("*", "/") & F.coalesce(heads | F.array_contains(said, "PROGRAM-ID"), F.lit(False))
    formed = leading(at(w, 2)).isin(*EZT_FORMATS) & (at(w, 2).contains("(") | at(w, 3).startswith("("))
    easy = (
        ((at(w, 0) == "JOB") & (at(w, 1) == "INPUT")) | ((at(w, 0) == "SORT") & (at(w, 2) == "TO") & (at(w, 4) == "USING"))
        | ((at(w, 0) == "FILE") & is_name(at(w, 1), 128) & formed)
    )
    return (
        F.when(job, "JCL").when(operation.isin(*BMS_MACROS), "BMS").when((operation == "DBD") & operand.startswith("NAME="), "IMS_DBD").when(psb, "IMS_PSB").when(program, "COBOL").when(easy, "EASYTRIEVE")
    )


def names_file(line: Column) -> Column:
    """An Easytrieve FILE; FILE SECTION, STATUS and CONTROL are COBOL's."""
    w = words(line)
    third = F.get(w, F.lit(2))
    return (F.get(w, F.lit(0)) == "FILE") & is_name(F.get(w, F.lit(1)), 40) & ~F.get(w, F.lit(1)).isin("SECTION", "STATUS", "CONTROL") & (third.isNull() | leading(third).isin(*EZT_FILE_WORDS, "SYS"))


def names_job(line: Column) -> Column:
    w = words(line)
    second = F.get(w, F.lit(1))
    return F.get(w, F.lit(0)).isin("JOB", "JOB.") & (second.isNull() | (second == ".") | leading(second).isin(*EZT_JOB_WORDS))


def level_number(word: Column) -> Column:
    n = word.try_cast("int")
    return (F.length(word) <= 2) & (n.between(1, 49) | n.isin(66, 77, 88))


@contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """Within it, plans are made whose ``decode`` knows mainframe code pages and puts U+FFFD where bytes are malformed.

    Both settings are kept in the expression when the plan is made, so they matter to no action.
    """
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "true")
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def extension(path: Column) -> Column:
    """Lower case and without its dot; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]*)$", 1))


def kind_of_name(path: Column) -> Column:
    e = extension(path)
    return F.coalesce(*(F.when(e.isin(*names), kind) for kind, names in EXTENSIONS.items()))


def files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` of the candidates under ``root``, paths relative to it, in the order of no kind."""
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "content")
    plain = F.lit(base.split(":", 1)[1] if ":" in base.split("/", 1)[0] else base)
    relative = F.expr("substring(path, at_ + length(base_) + 1)")
    rows = rows.withColumn("base_", plain).withColumn("at_", F.expr("instr(path, base_)")).select(relative.alias("path"), "content")
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    skipped = F.exists(folders, lambda f: f.isin(*EXCLUDED_FOLDERS) | f.startswith("."))
    return rows.filter(~skipped & ~extension(F.col("path")).isin(*EXCLUDED_EXTENSIONS))


def code_page(content: Column) -> Column:
    """``(code_page, so_si)``: EBCDIC by its blanks, shift bytes and want of line feeds, else UTF-8 where the bytes are valid (or missing), else Shift_JIS."""
    latin = F.decode(content, "ISO-8859-1")
    share = F.try_divide(F.length(latin) - F.length(F.replace(latin, F.lit("@"), F.lit(""))), F.length(latin))
    shifted = latin.rlike("[\x0e\x0f]")
    ebcdic = (shifted & (share >= 0.05)) | (~latin.contains("\n") & (share >= 0.10))
    page = F.when(F.coalesce(ebcdic, F.lit(False)), "IBM930").when(F.coalesce(F.is_valid_utf8(content.cast("string")), F.lit(True)), "UTF-8").otherwise("Shift_JIS")
    return F.struct(page.alias("code_page"), F.coalesce(shifted, F.lit(False)).alias("so_si"))


def lines_of(text: Column) -> Column:
    """One kind of line end, no byte order mark."""
    return F.regexp_replace(F.regexp_replace(text, "^(﻿|ï»¿)", ""), "\r\n|\r|\u0085", "\n")


def decoded(rows: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds ``code_page, so_si, text, readable`` to ``(path, content)``; malformed bytes make a file unreadable, and nothing else.

    ``overrides(name, code_page)`` name a relative path or, after that, a file name; each name once.
    """
    rows = rows.withColumn("page_", code_page(F.col("content")))
    page = F.col("page_.code_page")
    if overrides is not None:
        named = overrides.select(F.col("name"), F.col("code_page").alias("own_"))
        rows = rows.join(named.withColumnRenamed("name", "path"), "path", "left")
        rows = rows.withColumn("name_", F.substring_index("path", "/", -1)).join(named.select(F.col("name").alias("name_"), F.col("own_").alias("by_name_")), "name_", "left").drop("name_")
        page = F.coalesce("own_", "by_name_", page)
    rows = rows.select("path", "content", page.alias("code_page"), F.col("page_.so_si").alias("so_si"))
    with java_charsets(rows.sparkSession):
        rows = rows.withColumn("text_", F.expr("decode(content, code_page)"))
    good = F.when(F.col("code_page") == "UTF-8", F.is_valid_utf8(F.col("content").cast("string"))).otherwise(~F.col("text_").contains("�"))
    rows = rows.withColumn("readable", F.coalesce(good, F.lit(False)))
    return rows.withColumn("text", F.when(F.col("readable"), lines_of(F.col("text_")))).drop("text_")


def kind_of_content(rows: DataFrame) -> DataFrame:
    """Adds ``content_kind`` and ``binary`` to ``(path, content, ...)``: the first deciding line, then weaker signs of the whole text."""
    ebcdic = code_page(F.col("content"))["code_page"] == "IBM930"
    with java_charsets(rows.sparkSession):
        text = F.when(ebcdic, F.expr("decode(content, 'IBM037')")).otherwise(F.expr("decode(content, 'ISO-8859-1')"))
        rows = rows.withColumn("seen_", F.regexp_replace(lines_of(text), r"(?m)^/\*(?s:.*?)\*/", ""))
    rows = rows.withColumn("lines_", F.split("seen_", "\n"))
    seen, lines = F.col("seen_"), F.col("lines_")
    some = lambda p: F.coalesce(F.exists(lines, p), F.lit(False))
    decided = F.get(F.array_compact(F.transform(lines, deciding)), F.lit(0))
    # the first line that is no comment of any kind
    comment = lambda x: x.startswith("//*") | x.startswith("/*") | x.startswith("--") | x.startswith("*") | F.substring(x, 7, 1).isin("*", "/")
    first = F.coalesce(F.get(F.filter(lines, lambda x: (F.trim(x) != "") & ~comment(x)), F.lit(0)), F.lit(""))
    lead = words(F.upper(first))
    ezt_file, ezt_job = some(names_file), some(names_job)
    parm = (F.get(lead, F.lit(0)) == "PARM") & (F.size(lead) > 1)
    easytrieve = (ezt_file & ezt_job) | (parm & (ezt_file | ezt_job)) | (F.get(fields(F.upper(first)), F.lit(0)) == "MACRO")
    ends = F.regexp_replace(seen, r"'[^']*'|--[^\n]*|/\*(?s:.*?)\*/", "").contains(";") | some(lambda x: directive(x).isNotNull())
    item = words(F.substring(first, 8, 65))
    sql = F.get(lead, F.lit(0)).isin(*SQL_WORDS) & (F.length(first) - F.length(F.ltrim(first)) <= 6)
    weak = F.when(level_number(F.get(item, F.lit(0))) & (F.size(item) > 1), "COPYBOOK").when(easytrieve, "EASYTRIEVE").when(sql & ends, "SQL")
    binary = F.coalesce(F.decode(F.col("content"), "ISO-8859-1").contains("\x00"), F.lit(False))
    return rows.withColumns({"content_kind": F.when(~binary, F.coalesce(decided, weak)), "binary": binary}).drop("seen_", "lines_")


def assets(spark: SparkSession, root: str, overrides: DataFrame | None = None) -> DataFrame:
    """``(path, kind, mismatch, code_page, so_si, readable, text)``; content goes before the extension, binary files are left out.

    ``kind`` is null where neither tells.
    """
    rows = kind_of_content(decoded(files(spark, root), overrides)).filter("not binary")
    named = kind_of_name(F.col("path"))
    return rows.select(
        "path", F.coalesce("content_kind", named).alias("kind"), F.coalesce(F.col("content_kind") != named, F.lit(False)).alias("mismatch"),
        "code_page", "so_si", "readable", "text",
    )


def transactions(tables: DataFrame) -> DataFrame:
    """``(transaction, program)`` of CSV texts ``(path, text)``: two fields of the shape of member names, the last row of a transaction wins."""
    rows = tables.select("path", F.posexplode(F.split("text", "\n")).alias("line", "raw")).filter("line > 0")
    fields = F.transform(F.split(F.regexp_replace("raw", "\r", ""), ","), F.trim)
    good = (F.size("f") == 2) & F.forall("f", lambda x: x.rlike("^[A-Za-z0-9@#$-]{1,8}$"))
    rows = rows.withColumn("f", fields).filter(good)
    return rows.groupBy(F.upper(F.col("f")[0]).alias("transaction")).agg(F.max_by(F.upper(F.col("f")[1]), F.struct("path", "line")).alias("program"))
