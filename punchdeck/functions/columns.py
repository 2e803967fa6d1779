"""Scalar functions on mainframe values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def storage_bytes(usage: Column, digits: Column) -> Column:
    """DISPLAY: a byte a digit; packed: half a byte and the sign; binary: 2, 4 or 8."""
    binary = F.when(digits <= 4, 2).when(digits <= 9, 4).otherwise(8)
    return F.when(usage == "PACKED_DECIMAL", F.floor((digits + 2) / 2)).when(usage == "BINARY", binary).otherwise(digits).cast("long")


def usage(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t.rlike("^(COMP-3|COMPUTATIONAL-3|PACKED-DECIMAL)$"), "PACKED_DECIMAL").when(t.rlike("^(COMP|COMPUTATIONAL|BINARY|COMP-[45]|COMPUTATIONAL-[45])$"), "BINARY").otherwise("DISPLAY")


def bypasses_at_zero(op: Column, code: Column) -> Column:
    """COND test (code op return code) true for return code 0: such a step never runs after success."""
    return F.when(op.isin("EQ", "LE"), code == 0).when(op == "NE", code != 0).when(op == "GT", code > 0).when(op == "GE", code >= 0).otherwise(code < 0)


def disposition(text: Column) -> Column:
    """DISP=(status,normal,abnormal); the status is NEW if it is left out."""
    parts = F.split(F.regexp_replace(F.upper(text), r"[() ]", ""), ",")
    part = lambda k: F.nullif(F.get(parts, k), F.lit(""))
    return F.struct(F.coalesce(part(0), F.lit("NEW")).alias("status"), part(1).alias("normal"), part(2).alias("abnormal"))


def dataset(text: Column) -> Column:
    """Name, member, relative generation, whether temporary, referback of a DSN."""
    bracket = F.regexp_extract(text, r"\(([^)]*)\)$", 1)
    number = bracket.rlike(r"^[+-]?[0-9]+$")
    return F.struct(
        F.regexp_extract(text, r"^([^(]*)", 1).alias("name"), F.when((bracket != "") & ~number, bracket).alias("member"),
        F.when(number, bracket.try_cast("int")).alias("gdg"), text.startswith("&&").alias("temporary"),
        F.when(text.startswith("*."), text).alias("referback"),
    )


def unqualified(name: Column) -> Column:
    return F.upper(F.element_at(F.split(name, r"\."), -1))


def member_name(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))


def blanked(text: Column) -> Column:
    """Upper case, literals emptied, comments and runs of blanks made one blank."""
    kept = F.regexp_replace(text, r"('[^']*')|--[^\n]*|/\*(?s:.*?)\*/", "$1 ")
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(kept, r"'[^']*'", "''"), r"\s+", " ")))


def outermost(text: Column, depth: int = 8) -> Column:
    """A statement without what stands in brackets, up to ``depth`` deep: the clauses of its own."""
    for _ in range(depth):
        text = F.regexp_replace(text, r"\([^()]*\)", "<>")
    return text


# Kinds of statements by their first word.
FIRST_WORDS = {
    "INSERT": "INSERT", "UPDATE": "UPDATE", "DELETE": "DELETE", "MERGE": "MERGE", "OPEN": "OPEN", "FETCH": "FETCH", "CLOSE": "CLOSE", "COMMIT": "COMMIT", "ROLLBACK": "ROLLBACK",
    "SAVEPOINT": "SAVEPOINT", "CALL": "CALL", "LOCK": "LOCK_TABLE", "SET": "SET", "PREPARE": "PREPARE", "DESCRIBE": "DESCRIBE", "WHENEVER": "WHENEVER", "INCLUDE": "INCLUDE",
    "BEGIN": "BEGIN_DECLARE_SECTION", "END": "END_DECLARE_SECTION", "GET": "GET_DIAGNOSTICS", "CONNECT": "CONNECT", "TRUNCATE": "TRUNCATE", "ALLOCATE": "ALLOCATE_CURSOR", "ASSOCIATE": "ASSOCIATE_LOCATORS",
    "CREATE": "DDL", "ALTER": "DDL", "DROP": "DDL", "GRANT": "DDL", "REVOKE": "DDL", "COMMENT": "DDL", "LABEL": "DDL", "RENAME": "DDL",
}


def statement_kind(text: Column) -> Column:
    """Kind of an SQL statement by its leading words; literals and what stands in brackets don't count."""
    t = outermost(blanked(text))
    first = F.regexp_extract(t, r"^([A-Z]+)", 1)
    declared = (
        F.when(t.rlike(r"\bCURSOR\b"), "DECLARE_CURSOR").when(t.rlike(r"\bTABLE\b"), "DECLARE_TABLE")
        .when(t.rlike(r"\bSTATEMENT\b"), "DECLARE_STATEMENT").when(t.rlike(r"\bVARIABLE\b"), "DECLARE_VARIABLE").otherwise("OTHER")
    )
    return (
        F.when(first.isin("SELECT", "WITH"), F.when(t.rlike(r"^[^;]*?\bINTO ?:"), "SELECT_INTO").when(t.rlike(r"\bINTO\b"), "SELECT_INTO").otherwise("SELECT"))
        .when(first == "DECLARE", declared).when(first == "RELEASE", F.when(t.contains(" SAVEPOINT"), "RELEASE_SAVEPOINT").otherwise("OTHER"))
        .when(first == "VALUES", F.when(t.contains(" INTO "), "VALUES_INTO").otherwise("OTHER")).when(first == "EXECUTE", F.when(t.startswith("EXECUTE IMMEDIATE"), "EXECUTE_IMMEDIATE").otherwise("EXECUTE"))
        .otherwise(F.coalesce(F.create_map(*(F.lit(x) for kv in FIRST_WORDS.items() for x in kv))[first], F.lit("OTHER")))
    )


def table_names(text: Column) -> Column:
    """Tables that the words before them name, in upper case, each once: FROM and JOIN with lists and correlation names,
    INTO, UPDATE, USING, LOCK TABLE, TRUNCATE. Host variables and subqueries are none."""
    t = blanked(text)
    lists = F.regexp_extract_all(t, F.lit(r"\b(?:FROM|JOIN|INTO|UPDATE|USING|LOCK TABLE|TRUNCATE(?: TABLE)?) ((?:[A-Z0-9_@#$.]+(?: (?:AS )?(?!WHERE\b|ON\b|SET\b|JOIN\b|LEFT\b|RIGHT\b|INNER\b|FULL\b|CROSS\b|GROUP\b|ORDER\b|UNION\b|VALUES\b|SELECT\b|FETCH\b|FOR\b|WITH\b|IN\b|WHEN\b|USING\b|HAVING\b|INTO\b|FROM\b)[A-Z0-9_@#$]+)?(?: ?, ?)?)+)"), 1)
    names = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), lambda y: F.regexp_extract(F.trim(y), r"^([A-Z0-9_@#$.]+)", 1))))
    return F.array_distinct(F.filter(names, lambda x: (x != "") & ~x.isin("SELECT", "FINAL", "TABLE", "OLD", "NEW", "LATERAL", "SET")))


def cursor_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(blanked(text), r"^(?:DECLARE(?= [A-Z0-9_-]+ (?:\w+ )*CURSOR\b)|OPEN|CLOSE|ALLOCATE|FETCH(?: (?:NEXT|PRIOR|FIRST|LAST|CURRENT))?(?: FROM)?) ([A-Z0-9_-]+)", 1), F.lit(""))


def positioned_cursor(text: Column) -> Column:
    return F.nullif(F.regexp_extract(blanked(text), r"\bWHERE CURRENT OF ([A-Z0-9_-]+)", 1), F.lit(""))


def isolation(text: Column) -> Column:
    """Isolation clause of a statement; a common table of that name has AS or a column list behind it."""
    return F.nullif(F.regexp_extract(blanked(text), r"\bWITH (UR|CS|RS|RR)\b(?! ?(?:AS\b|\())", 1), F.lit(""))


def whenever(text: Column) -> Column:
    """Condition and action of WHENEVER."""
    p = r"^WHENEVER (SQLERROR|SQLWARNING|NOT FOUND) (CONTINUE|GO ?TO :?[A-Z0-9-]+|DO .+)$"
    t = blanked(text)
    return F.when(t.rlike(p), F.struct(F.regexp_extract(t, p, 1).alias("condition"), F.regexp_replace(F.regexp_extract(t, p, 2), "^GO ?TO :?", "GO TO ").alias("action")))


def top_level_items(text: Column) -> Column:
    """Items of a list, split at commas outside of brackets and literals."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"((?:[^,()']|'[^']*'|\((?:[^()']|'[^']*'|\((?:[^()']|'[^']*'|\([^()]*\))*\))*\))+)"), 1), lambda x: F.trim(x))


def plain_column(text: Column) -> Column:
    return text.rlike(r"(?i)^[A-Z@#$_][A-Z0-9@#$_]*(\.[A-Z@#$_][A-Z0-9@#$_]*){0,2}$")


def crud(letters: Column) -> Column:
    """Letters of a set in the order R C U D."""
    return F.array_join(F.filter(F.array(*map(F.lit, "RCUD")), lambda x: F.array_contains(letters, x)), "")


def crud_of_kind(kind: Column) -> Column:
    """Letters of a statement's kind; dynamic SQL is told by ``?``."""
    return (
        F.when(kind == "INSERT", "C").when(kind == "UPDATE", "U").when(kind.isin("DELETE", "TRUNCATE"), "D").when(kind == "MERGE", "CU")
        .when(kind.isin("PREPARE", "EXECUTE", "EXECUTE_IMMEDIATE"), "?").otherwise("R")
    )


def level(severity: Column) -> Column:
    """Level of a severity in SARIF."""
    s = F.upper(severity)
    return F.when(s == "HIGH", "error").when(s.isin("MEDIUM", "ADVISORY"), "warning").when(s == "LOW", "note")


def exit_code(level_: Column) -> Column:
    return F.when(level_ == "error", 2).when(level_ == "warning", 1).otherwise(0)
