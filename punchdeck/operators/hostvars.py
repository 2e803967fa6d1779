"""Host variables of embedded SQL against the columns that a program declares (DECLARE TABLE), as joins by place and by name.

Lists are told by tokens and clauses of ``sqlscope``; a statement is keyed by its program and the place of its EXEC SQL. Findings are
those of ``program_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.functions import columns as C
from punchdeck.functions.picture import picture
from punchdeck.operators import sqlscope
from punchdeck.operators.graph import cut

NAME = r"[\p{L}\p{N}$#@_-]"
HOST = rf"^:\s*({NAME}+)"
DECLARE = r"(?i)^DECLARE\s+([\p{L}\p{N}$#@_.-]+)\s+TABLE\s*\((.*)\)$"
COLUMN = rf"(?i)^({NAME}+)\s+(\p{{L}}+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?(.*)$"
CURSOR = rf"(?i)^DECLARE\s+({NAME}+)\s+CURSOR\b"
FETCH = rf"(?i)^FETCH\s+(?:(?:NEXT|PRIOR|FIRST|LAST|CURRENT|ABSOLUTE|RELATIVE)\s+)?(?:FROM\s+)?({NAME}+)"
# PICTUREs of types that have one whatever their length.
PICTURES = {"DATE": "X(10)", "TIME": "X(8)", "TIMESTAMP": "X(26)", "SMALLINT": "S9(4) COMP", "INT": "S9(9) COMP", "INTEGER": "S9(9) COMP", "BIGINT": "S9(18) COMP"}


def short(table: Column) -> Column:
    return F.upper(F.element_at(F.split(table, r"\."), -1))


def blocks(tokens: DataFrame) -> DataFrame:
    """``(stmt, program, pos, line, raw, text)``: EXEC SQL of ``cobol.tokens``; ``text`` is what stands inside, in one line."""
    rows = tokens.filter(F.col("token").rlike(r"(?i)^EXEC\s+SQL\b"))
    plain = F.trim(F.regexp_replace("token", r"\s+", " "))
    inside = F.regexp_replace(F.trim(F.regexp_replace(plain, r"(?i)^EXEC SQL|\bEND-EXEC\s*\.?$", "")), r"\s*\.$", "")
    return rows.select(F.struct("program", "pos").alias("stmt"), "program", "pos", "line", F.col("token").alias("raw"), inside.alias("text"))


def declared(blocks: DataFrame) -> DataFrame:
    """``(program, table, at, name, type, length, scale, nullable)``: the columns of each table's first DECLARE TABLE, ``at`` from 0."""
    rows = blocks.withColumn("table", short(F.regexp_extract("text", DECLARE, 1))).filter("table <> ''")
    rows = rows.withColumn("first", F.min("pos").over(Window.partitionBy("program", "table"))).filter("pos = first")
    parts = F.filter(C.top_level_items(F.regexp_extract("text", DECLARE, 2)), lambda x: x.rlike(COLUMN))
    rows = rows.select("program", "table", F.posexplode(parts).alias("at", "x"))
    number = lambda g: F.coalesce(F.regexp_extract("x", COLUMN, g).try_cast("int"), F.lit(0))
    name, kind = (F.upper(F.regexp_extract("x", COLUMN, g)) for g in (1, 2))
    return rows.select("program", "table", "at", name.alias("name"), kind.alias("type"), number(3).alias("length"), number(4).alias("scale"), (~F.regexp_extract("x", COLUMN, 5).rlike(r"(?i)\bNOT\s+NULL\b")).alias("nullable"))


def _entries(rows: DataFrame, level: int) -> DataFrame:
    """``(stmt, at, t)``: words of a list with ``depth`` of brackets, cut at commas of ``level``."""
    w = Window.partitionBy("stmt").orderBy("pos")
    rows = rows.withColumn("at", F.count_if((F.col("token") == ",") & (F.col("depth") == level)).over(w)).filter(~((F.col("token") == ",") & (F.col("depth") == level)))
    return rows.groupBy("stmt", F.col("at").cast("int").alias("at")).agg(F.sort_array(F.collect_list(F.struct("pos", "token", "word"))).alias("t"))


def _hosts(words: Column) -> Column:
    return F.transform(F.filter(words, lambda x: x["token"].startswith(":")), lambda x: F.upper(F.regexp_extract(x["token"], HOST, 1)))


def _named(words: Column) -> Column:
    """The column that words are: a name, with qualifiers or without; else null."""
    whole = F.array_join(F.transform(words, lambda x: x["token"]), "")
    return F.when(whole.rlike(r'^[\p{L}\p{N}$#@_."-]+$'), F.element_at(words, -1)["word"])


def _alone(words: Column) -> Column:
    """Whether words are a host variable and perhaps its indicator, and nothing else."""
    return F.forall(words, lambda x: x["token"].startswith(":") & ~F.contains(x["token"], F.lit(".")) | (x["word"] == "INDICATOR")) & F.size(_hosts(words)).between(1, 2)


def _clauses(blocks: DataFrame) -> DataFrame:
    """Tokens of the statements' outermost level, and of brackets in it, with ``depth`` within their clause and ``verb``, the statement's first word."""
    rows = sqlscope.tokens(blocks.select("stmt", "text")).filter("block = 0 and arm = 0")
    w = Window.partitionBy("stmt").orderBy("pos")
    rows = rows.withColumns({"verb": F.first("word").over(w), "starts": F.col("own") & (F.col("word") == F.col("clause"))})
    rows = rows.withColumn("part", F.count_if("starts").over(w))
    within = Window.partitionBy("stmt", "part").orderBy("pos")
    opened = F.sum(F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)).over(within)
    return rows.withColumn("depth", F.when(F.col("token") == "(", opened - 1).otherwise(opened)).withColumn("nth", F.row_number().over(within))


def _first_name(rows: DataFrame, clause: str) -> DataFrame:
    """``(stmt, table)``: the name that the first such clause begins with, without qualifiers."""
    w = Window.partitionBy("stmt").orderBy("pos")
    rows = rows.withColumns({f"n{k}": F.lead("word", k).over(w) for k in (1, 2, 3, 4, 5)}).filter((F.col("clause") == clause) & F.col("starts"))
    name = F.when((F.col("n2") == ".") & (F.col("n4") == "."), F.col("n5")).when(F.col("n2") == ".", F.col("n3")).otherwise(F.col("n1"))
    return rows.groupBy("stmt").agg(F.min_by(name, "pos").alias("table"))


def _listed(rows: DataFrame, clause: str) -> DataFrame:
    """Words of the first clause of that name, without the word that begins it."""
    first = F.min(F.when(F.col("clause") == clause, F.col("part"))).over(Window.partitionBy("stmt"))
    return rows.withColumn("wanted", first).filter("part = wanted and not starts")


def read_pairs(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """``(stmt, at, name, type, length, scale, nullable, host, indicator)``: columns that SELECT INTO and FETCH give, and what takes them.

    A list of a star alone means all columns in their order, also for one structure that takes them all. Lists of different lengths, and
    INTO without a host variable at a place, give no pairs.
    """
    rows = cut(_clauses(blocks.filter(F.upper("text").rlike(r"^(SELECT|FETCH|DECLARE\s+\S+\s+CURSOR)\b"))))
    items = _entries(_listed(rows.filter("verb <> 'FETCH'"), "SELECT").filter("word not in ('ALL', 'DISTINCT') or depth > 0"), 0)
    taken = _entries(_listed(rows.filter("verb in ('SELECT', 'FETCH')"), "INTO"), 0).withColumn("hosts", _hosts(F.col("t")))
    whole = Window.partitionBy("stmt")
    taken = taken.withColumns({"n_taken": F.count("*").over(whole), "bare": F.count_if(F.size("hosts") == 0).over(whole)}).filter("bare = 0")
    taken = taken.select("stmt", "at", F.get("hosts", F.lit(0)).alias("host"), F.get("hosts", F.lit(1)).alias("indicator"), "n_taken")
    items = items.withColumns({"n_items": F.count("*").over(whole), "star": (F.size("t") == 1) & (F.get("t", F.lit(0))["token"] == "*"), "name": _named(F.col("t"))})
    items = items.select(F.col("stmt").alias("query"), F.col("at").alias("item"), "name", "n_items", F.col("star") & (F.col("n_items") == 1))
    items = items.toDF("query", "item", "name", "n_items", "star")
    named = blocks.withColumns({"cursor": F.upper(F.regexp_extract("text", CURSOR, 1)), "fetched": F.upper(F.regexp_extract("text", FETCH, 1))})
    cursors = named.filter("cursor <> ''").groupBy("program", "cursor").agg(F.min_by("stmt", "pos").alias("query"))
    fetches = named.filter("fetched <> ''").select("stmt", "program", F.col("fetched").alias("cursor")).join(cursors, ["program", "cursor"]).select("stmt", "query")
    asked = blocks.filter(F.upper("text").rlike(r"^SELECT\b")).select("stmt", F.col("stmt").alias("query")).union(fetches)
    table = _first_name(rows.filter("verb <> 'FETCH'"), "FROM").withColumnRenamed("stmt", "query")
    met = asked.join(table, "query").withColumn("program", F.col("stmt.program"))
    cols = declared.withColumn("n_columns", F.count("*").over(Window.partitionBy("program", "table")))
    given = met.join(items.drop("name"), "query").filter("star").join(cols, ["program", "table"])
    stars = given.join(taken.withColumnRenamed("at", "place"), "stmt").filter("n_taken = 1 or (n_taken = n_columns and place = at)")
    by_name = met.join(items.filter("not star and name is not null"), "query").join(taken.withColumnRenamed("at", "item"), ["stmt", "item"]).filter("n_items = n_taken")
    plain = by_name.join(cols.drop("at"), ["program", "table", "name"]).withColumnRenamed("item", "at")
    shown = ["stmt", "at", "name", "type", "length", "scale", "nullable", "host", "indicator"]
    return stars.select(*shown).union(plain.select(*shown))


def write_pairs(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """As ``read_pairs``: columns that UPDATE SET and INSERT VALUES fill from a host variable alone."""
    rows = cut(_clauses(blocks.filter(F.upper("text").rlike(r"^(UPDATE|INSERT\s+INTO)\b"))))
    sets = _entries(_listed(rows.filter("verb = 'UPDATE'"), "SET"), 0)
    equals = F.array_position(F.transform("t", lambda x: x["token"]), "=").cast("int")
    sets = sets.withColumn("equals", equals).filter("equals > 1")
    sets = sets.select("stmt", "at", _named(F.slice("t", F.lit(1), F.col("equals") - 1)).alias("name"), F.slice("t", F.col("equals") + 1, F.size("t")).alias("value"))
    bracket = lambda clause: _entries(_inside(_listed(rows.filter("verb = 'INSERT'"), clause)), 1)
    whole = Window.partitionBy("stmt")
    names = bracket("INTO").select("stmt", "at", _named(F.col("t")).alias("name"), F.count("*").over(whole).alias("n"))
    values = bracket("VALUES").select("stmt", "at", F.col("t").alias("value"), F.count("*").over(whole).alias("n"))
    filled = sets.union(names.join(values, ["stmt", "at", "n"]).select("stmt", "at", "name", "value"))
    tables = _first_name(rows.filter("verb = 'UPDATE'"), "UPDATE").union(_first_name(rows.filter("verb = 'INSERT'"), "INTO"))
    met = filled.filter(_alone(F.col("value"))).withColumns({"hosts": _hosts(F.col("value")), "program": F.col("stmt.program")}).join(tables, "stmt").join(declared.drop("at"), ["program", "table", "name"])
    return met.select("stmt", "at", "name", "type", "length", "scale", "nullable", F.get("hosts", F.lit(0)).alias("host"), F.get("hosts", F.lit(1)).alias("indicator"))


def _inside(rows: DataFrame) -> DataFrame:
    """Words of a clause's first bracket."""
    w = Window.partitionBy("stmt").orderBy("pos")
    rows = rows.withColumn("bracket", F.count_if((F.col("token") == "(") & (F.col("depth") == 0)).over(w)).filter("bracket = 1")
    closed = F.max((F.col("token") == ")") & (F.col("depth") == 0)).over(w)
    return rows.withColumn("closed", closed).filter("not closed and not (token = '(' and depth = 0)")


def line_of(raw: Column, line: Column, host: Column) -> Column:
    """The line of a block on which a host variable stands first."""
    before = F.get(F.split(F.upper(raw), F.concat(F.lit(r":\s*\Q"), host, F.lit(rf"\E(?!{NAME})")), 2), 0)
    return (line + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int")


def expected(kind: Column, length: Column, scale: Column) -> Column:
    """The PICTURE and usage that a column's type needs; null where there is no one answer."""
    text = F.when(kind.isin("CHAR", "CHARACTER"), F.concat(F.lit("X("), F.greatest(length, F.lit(1)), F.lit(")")))
    packed = F.when(scale == 0, F.concat(F.lit("S9("), length, F.lit(") COMP-3"))).otherwise(F.concat(F.lit("S9("), length - scale, F.lit(")V9("), scale, F.lit(") COMP-3")))
    fixed = F.create_map(*[F.lit(x) for pair in PICTURES.items() for x in pair])[kind]
    return F.coalesce(text, F.when(kind.isin("DECIMAL", "DEC", "NUMERIC") & (length > 0), packed), fixed)


def pictures(items: DataFrame) -> DataFrame:
    """``(program, name, shown)``: elementary items in one way of writing, the first of each name; ``?`` for edited ones."""
    first = items.filter("level not in (66, 88)").groupBy("program", F.upper("name").alias("name")).agg(F.min_by(F.struct("picture", "usage"), "idx").alias("x"))
    rows = first.select("program", "name", F.col("x.picture").alias("pic"), F.col("x.usage").alias("usage")).filter("pic is not null").withColumn("p", picture("pic")).filter("p.category <> 'UNKNOWN'")
    p = F.col("p")
    digits = F.concat(F.when(p["signed"], "S").otherwise(""), F.lit("9("), p["int_digits"], F.lit(")"), F.when(p["frac_digits"] > 0, F.concat(F.lit("V9("), p["frac_digits"], F.lit(")"))).otherwise(""))
    usage = F.when(F.col("usage").isin("COMP-3", "PACKED-DECIMAL"), " COMP-3").when(F.col("usage").isin("COMP", "COMP-4", "COMP-5", "BINARY"), " COMP").otherwise("")
    shown = F.when(p["category"].isin("ALPHANUMERIC", "ALPHABETIC"), F.concat(F.lit("X("), p["positions"], F.lit(")"))).when(p["category"] == "NUMERIC", F.concat(digits, usage)).otherwise("?")
    return rows.select("program", "name", shown.alias("shown"))


def host_rules(tokens: DataFrame, items: DataFrame) -> DataFrame:
    """R037: nullable columns received without an indicator, once for each statement, at the first. R038: an elementary item whose PICTURE doesn't
    fit its column, or an indicator that is no S9(4) COMP, the first of each line."""
    held = cut(blocks(tokens))
    cols = cut(declared(held))
    reads, writes = cut(read_pairs(held, cols)), write_pairs(held, cols)
    at = held.select("stmt", "program", "line", "raw")
    missing = reads.filter("nullable and indicator is null").groupBy("stmt").agg(F.min_by("host", "at").alias("host"), F.sort_array(F.collect_list(F.struct("at", "name"))).alias("c"))
    missing = missing.withColumn("subject", F.array_join(F.array_distinct(F.transform("c", lambda x: x["name"])), ", ")).join(at, "stmt")
    null = missing.select("program", line_of(F.col("raw"), F.col("line"), F.col("host")).alias("line"), F.lit("R037").alias("rule_id"), "subject")
    every = reads.withColumn("part", F.lit(0)).union(writes.withColumn("part", F.lit(1)))
    known = pictures(items)
    met = every.withColumn("program", F.col("stmt.program")).join(known.withColumnsRenamed({"name": "host", "shown": "host_shown"}), ["program", "host"], "left").join(known.withColumnsRenamed({"name": "indicator", "shown": "indicator_shown"}), ["program", "indicator"], "left")
    wrong = F.when(F.col("host_shown") != expected(F.col("type"), F.col("length"), F.col("scale")), F.col("host")).when(F.col("indicator_shown") != "S9(4) COMP", F.col("indicator"))
    met = met.withColumn("subject", wrong).filter("subject is not null").join(at.drop("program"), "stmt")
    met = met.withColumn("line", line_of(F.col("raw"), F.col("line"), F.col("subject")))
    shape = met.groupBy("program", "stmt", "line").agg(F.min_by("subject", F.struct("part", "at")).alias("subject"))
    return null.union(shape.select("program", "line", F.lit("R038"), "subject"))
