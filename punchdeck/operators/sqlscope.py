"""Query blocks of SQL statements and what the names in them mean, by a pass over the tokens of a statement.

A block is the outermost text of a statement, or a bracket that holds a SELECT of its own; the branches of a set operation
are arms of one block. Tokens in other brackets (functions, lists) belong to the block around them. A name is looked for in
the sources of its own arm, then in those of the arm around its block, and so on outwards.

Statements are ``(stmt, text)``, ``stmt`` of any type; nothing is parsed to a tree, clauses are told by the last clause word
on the block's own level.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from itertools import pairwise
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.functions.columns import crud, statement_kind
from punchdeck.operators.graph import cut, dealt, each_group, each_row, written

TOKEN = r"""(--[^\n]*|/\*(?s:.*?)(?:\*/|\z)|'(?:[^']++|'')*+'?|"(?:[^"]++|"")*+"?|:\s*[\p{L}_][\p{L}\p{N}_.-]*|\p{N}[\p{L}\p{N}_]*|[\p{L}_@#$][\p{L}\p{N}_@#$]*|<>|<=|>=|!=|\^=|\|\||[^\s])"""
# Words that begin a clause on a block's own level.
CLAUSES = ("SELECT", "INTO", "FROM", "JOIN", "ON", "WHERE", "GROUP", "HAVING", "ORDER", "FETCH", "OPTIMIZE", "SET", "VALUES", "UPDATE", "DELETE", "INSERT", "MERGE", "USING", "WITH", "FOR", "UNION", "EXCEPT", "INTERSECT", "WHEN", "DECLARE", "QUERYNO")
# Other words that are no columns or correlation names.
WORDS = (
    "ALL", "AND", "ANY", "AS", "ASC", "BETWEEN", "BY", "CASE", "CAST", "CROSS", "CURRENT", "CURSOR", "DATE", "DAY", "DAYS", "DEFAULT", "DESC", "DISTINCT", "ELSE", "END", "ESCAPE", "EXISTS", "FINAL", "FIRST", "FULL", "HOLD",
    "HOUR", "HOURS", "IN", "INNER", "IS", "LAST", "LATERAL", "LEFT", "LIKE", "MATCHED", "MINUTE", "MINUTES", "MONTH", "MONTHS", "NEXT", "NOT", "NULL", "NULLS", "OF", "ONLY", "OR", "OUTER", "OVER", "PARTITION", "READ", "RIGHT", "ROW",
    "ROWS", "SECOND", "SECONDS", "SOME", "TABLE", "THEN", "TIME", "TIMESTAMP", "UR", "CS", "RS", "RR", "USER", "YEAR", "YEARS", "INTEGER", "CHAR", "DECIMAL", "VARCHAR", "SMALLINT",
)
COMPARISONS = ("=", "<", ">", "<=", ">=", "<>", "!=", "^=")


CLAUSE_SET, RESERVED = frozenset(CLAUSES), frozenset((*CLAUSES, *WORDS))
UNQUOTED = re.compile(r'^"|"$')


class Token(NamedTuple):
    """A token as the rows of ``tokens`` have it."""

    pos: int
    token: str
    word: str
    scope: tuple[int, ...]
    block: int
    own: bool
    arm: int
    clause: str | None


def _named(token: str) -> bool:
    """Whether a token is a word."""
    return token[0] in '_@#$"' or token[0].isalpha()


def _scoped(found: list[str]) -> list[Token]:
    """One statement's tokens with their blocks and clauses."""
    rows, opened, path, opens, closes, queries = [], {}, (), 0, 0, set()
    for pos, token in enumerate(found):
        if token[:2] in ("--", "/*"):
            continue
        word = UNQUOTED.sub("", token).replace('""', '"') if token[0] == '"' else token.upper()
        # a bracket belongs to what is around it
        closes += token == ")"
        if token in ("(", ")"):
            path = tuple(opened[k] for k in range(max(opens - closes, 0)))
        group = path[-1] if path else 0
        if word == "SELECT":
            queries.add(group)
        rows.append((pos, token, word, path, group))
        if token == "(":
            opened[opens - closes] = pos
            opens += 1
            path = tuple(opened[k] for k in range(max(opens - closes, 0)))
    out, scopes, arms, clauses = [], {}, {}, {}
    for pos, token, word, path, group in rows:
        scope = scopes.get(path)
        if scope is None:
            scope = scopes[path] = (0, *(p for p in path if p in queries))
        block = scope[-1]
        own = group == block
        if own and word in CLAUSE_SET:
            clauses[block] = word
            arms[block] = arms.get(block, 0) + (word in ("UNION", "EXCEPT", "INTERSECT"))
        out.append(Token(pos, token, word, scope, block, own, arms.get(block, 0), clauses.get(block)))
    return out


def _taken(stmts: DataFrame, *more: Column) -> DataFrame:
    """``(stmt, found)``: the tokens of each statement."""
    rows = dealt(stmts.select("stmt", F.col("text").alias("t"), *more), "stmt")
    return rows.select("stmt", F.regexp_extract_all("t", F.lit(TOKEN), F.lit(1)).alias("found"), *rows.columns[2:])


def tokens(stmts: DataFrame) -> DataFrame:
    """``(stmt, pos, token, word, scope, block, own, arm, clause)``: ``scope`` are the blocks around a token from the outermost (0), named by
    where their bracket stands, ``block`` the innermost; ``own`` if no other bracket of the block holds it."""
    return each_row(_taken(stmts), "stmt", _scoped, "pos int, token string, word string, scope array<int>, block int, own boolean, arm long, clause string")


def _each(tokens: DataFrame, run: Callable[[list[Token]], list[tuple]], columns: str) -> DataFrame:
    """What ``run`` returns for the tokens of each statement."""
    return each_group(tokens.select("stmt", *Token._fields), "stmt", lambda c: run([Token(*x) for x in zip(*(c[n] for n in Token._fields), strict=True)]), columns, "pos")


def _words(rows: list[Token]) -> list[str | None]:
    """The words of tokens with a margin of six, so that what stands near one can be asked for at the ends too."""
    return [None] * 6 + [t.word for t in rows] + [None] * 6


def _arms(rows: Iterable[Token]) -> list[list[Token]]:
    of: dict[tuple[int, int], list[Token]] = {}
    for t in rows:
        of.setdefault((t.block, t.arm), []).append(t)
    return list(of.values())


class Source(NamedTuple):
    block: int
    arm: int
    name: str | None
    alias: str | None
    target: bool


def _sources(rows: list[Token]) -> list[Source]:
    out, given = [], _common_tables(rows)
    for arm in _arms(t for t in rows if t.own):
        w, first = _words(arm), arm[0].word
        for i, t in enumerate(arm, 6):
            before = w[i - 1]
            starts = (t.clause in ("FROM", "JOIN", "USING") and before in ("FROM", ",", "JOIN", "USING")) or before == "UPDATE" or (before == "INTO" and first in ("INSERT", "MERGE"))
            derived = t.token == "("
            if not starts or not (derived or (_named(t.token) and t.word not in ("SELECT", "FINAL", "OLD", "NEW", "LATERAL"))) or (before == "UPDATE" and t.word in ("OF", "SET")):
                continue
            dotted = w[i + 1] == "."
            name = None if derived else t.word if not dotted else None if w[i + 2] is None else f"{t.word}.{w[i + 2]}"
            k = i + 1 if derived else i + 2 if dotted else i
            alias = w[k + 2] if w[k + 1] == "AS" else w[k + 1] if w[k + 1] and _named(w[k + 1]) and w[k + 1] not in RESERVED else None
            if alias is None and name is not None:
                alias = name.rsplit(".", 1)[-1]
            out.append(Source(t.block, t.arm, None if name in given else name, alias, before == "INTO" and first == "INSERT"))
    return out


def sources(tokens: DataFrame) -> DataFrame:
    """``(stmt, block, arm, name, alias, target)``: tables of FROM, JOIN, UPDATE, DELETE, INSERT and MERGE, in upper case; a derived table and one of a
    WITH clause have no name. ``alias`` is what columns are qualified by; no column of a SELECT means the ``target`` of an INSERT."""
    return _each(tokens, _sources, "block int, arm long, name string, alias string, target boolean")


def _common_tables(rows: list[Token]) -> set[str]:
    """The names of WITH clauses."""
    if not any(t.own and t.word == "WITH" for t in rows):
        return set()
    w, out = _words(rows), set()
    for i, t in enumerate(rows, 6):
        plain, listed = w[i + 1] == "AS" and w[i + 2] == "(", w[i + 1] == "(" and w[i - 1] == "WITH"
        if _named(t.token) and w[i - 1] in ("WITH", ",") and (plain or listed):
            out.add(t.word)
    return out


def _levels(rows: list[Token]) -> list[tuple]:
    inside = list(dict.fromkeys((t.block, t.arm, t.scope[-2] if len(t.scope) > 1 else None) for t in rows))
    opened = {t.pos: t.arm for t in rows if t.token == "("}
    up = {(block, above, opened[block]) for block, _, above in inside if above is not None}
    out = front = [(block, arm, 0, block, arm) for block, arm, _ in inside]
    for hop in range(1, max((len(t.scope) for t in rows), default=1)):
        front = [(block, arm, hop, above, its) for block, arm, _, at, _ in front for held, above, its in up if held == at]
        out = out + front
    return out


def levels(tokens: DataFrame) -> DataFrame:
    """``(stmt, block, arm, hop, up_block, up_arm)``: the arms around an arm; hop 0 is itself."""
    return _each(tokens, _levels, "block int, arm long, hop int, up_block int, up_arm long")


class Name(NamedTuple):
    pos: int
    block: int
    arm: int
    clause: str
    qualifier: str | None
    name: str


def _columns(rows: list[Token]) -> list[Name]:
    w, out = _words(rows), []
    for i, t in enumerate(rows, 6):
        if t.clause not in ("SELECT", "WHERE", "ON", "GROUP", "HAVING", "ORDER", "SET", "WHEN", "VALUES") or not _named(t.token):
            continue
        b1, n1 = w[i - 1], w[i + 1]
        if not (t.word not in RESERVED or t.token[0] == '"' or b1 == ".") or n1 in ("(", ".") or b1 in ("AS", "CAST"):
            continue
        # in a select list a word behind a value is its name
        if t.clause == "SELECT" and t.own:
            if b1 is None or b1 == "END":
                continue
            last = rows[i - 7].token
            if b1 not in RESERVED and (last[0] in "_@#$\"':)" or unicodedata.category(last[0])[0] in "LN"):
                continue
        qualifier = None
        if b1 == ".":
            b2, b3, b4 = w[i - 2], w[i - 3], w[i - 4]
            qualifier = b2 if b3 != "." else None if b4 is None or b2 is None else f"{b4}.{b2}"
        out.append(Name(t.pos, t.block, t.arm, t.clause, qualifier, t.word))
    return out


def columns(tokens: DataFrame) -> DataFrame:
    """``(stmt, pos, block, arm, clause, qualifier, name)``: columns that are named, in upper case. Correlation names, functions, host
    variables, names behind AS and the column lists of INSERT are none."""
    return _each(tokens, _columns, "pos int, block int, arm long, clause string, qualifier string, name string")


def _met(rows: list[Token]) -> list[tuple]:
    """Columns beside each source that is around them; one that an arm names several times once, names that a select list gives left out."""
    w = _words(rows)
    given = {t.word for i, t in enumerate(rows, 6) if w[i - 1] == "AS" and t.clause == "SELECT"}
    names = {(n.block, n.arm, n.qualifier, n.name): n for n in reversed(_columns(rows)) if n.name not in given}
    at: dict[tuple[int, int], list[Source]] = {}
    for s in _sources(rows) if names else ():
        if not s.target:
            at.setdefault((s.block, s.arm), []).append(s)
    around: dict[tuple[int, int], list[tuple[int, Source]]] = {}
    for block, arm, hop, *place in _levels(rows) if at else ():
        around.setdefault((block, arm), []).extend((hop, s) for s in at.get(tuple(place), ()))
    return [(*n, hop, s.name, s.alias) for n in names.values() for hop, s in around.get((n.block, n.arm), ())]


def declared(statements: DataFrame) -> DataFrame:
    """``(table, columns)``: the columns that DECLARE TABLE, CREATE TABLE and ADD COLUMN say, of all statements together."""
    # each of these says TABLE, and few others do
    statements = statements.filter(F.contains(F.upper("text"), F.lit("TABLE")))
    t = F.regexp_replace(F.regexp_replace("text", r"--[^\n]*|/\*(?s:.*?)\*/", " "), r"\s+", " ")
    u = F.upper(F.trim(t))
    made = r"^(?:EXEC SQL )?(?:DECLARE ([^\s(]+) TABLE|CREATE TABLE ([^\s(]+)) ?\((.*)\)"
    parts = F.split(F.regexp_replace(F.regexp_extract(u, made, 3), r"\([^()]*\)", ""), ",")
    names = F.filter(F.transform(parts, lambda x: F.regexp_extract(F.trim(x), r'^"?([^\s"]+)', 1)), lambda x: ~x.isin("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT", ""))
    added = r"^(?:EXEC SQL )?ALTER TABLE (\S+) (.*)$"
    more = F.regexp_extract_all(F.regexp_extract(u, added, 2), F.lit(r"\bADD (?:COLUMN )?(?!CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK)([^\s,()]+)"), F.lit(1))
    table = F.concat(F.regexp_extract(u, made, 1), F.regexp_extract(u, made, 2))
    rows = statements.select(F.when(table != "", table).otherwise(F.regexp_extract(u, added, 1)).alias("table"), F.when(table != "", names).otherwise(more).alias("columns")).filter("table <> '' and size(columns) > 0")
    # one row a column, so that the declarations of a table are combined before they meet
    return rows.select("table", F.explode("columns").alias("c")).groupBy("table").agg(F.sort_array(F.collect_set("c")).alias("columns"))


def with_declarations(sources: DataFrame, declared: DataFrame) -> DataFrame:
    """``sources`` with ``columns`` of the table: of that very name, else of its short name, if it isn't one that a schema claims while the source names another."""
    short = F.element_at(F.split("table", r"\."), -1)
    by_short = declared.select(short.alias("short"), "table", F.explode("columns").alias("c")).groupBy("short").agg(F.collect_set("c").alias("short_columns"), F.max(F.contains("table", F.lit("."))).alias("claimed"))
    rows = sources.join(declared.select(F.col("table").alias("name"), "columns"), "name", "left").withColumn("short", F.element_at(F.split("name", r"\."), -1)).join(by_short, "short", "left")
    fits = ~(F.col("claimed") & (F.col("name") != F.col("short")))
    return rows.withColumn("columns", F.coalesce("columns", F.when(fits, F.col("short_columns")))).select(*sources.columns, "columns")


def resolved(columns: DataFrame, levels: DataFrame, sources: DataFrame) -> DataFrame:
    """``columns`` with ``table`` of the source that is meant and ``missing``: whether declarations say that there is no such column.

    A qualified name means the innermost source of that alias. Another means the innermost source whose declaration has the
    column; it is missing if all sources around it are declared and none has it; without declarations it means the only
    source around it, if there is just one.
    """
    near = columns.join(levels, ["stmt", "block", "arm"]).join(sources.filter("not target").select("stmt", F.col("block").alias("up_block"), F.col("arm").alias("up_arm"), F.col("name").alias("table"), "alias", "columns"), ["stmt", "up_block", "up_arm"])
    return _meant(near)


def _meant(near: DataFrame) -> DataFrame:
    """``resolved`` of columns beside each source that is around them."""
    has = F.coalesce(F.array_contains("columns", F.col("name")), F.lit(False))
    meant = (F.col("qualifier") == F.col("alias")) | (F.col("qualifier") == F.col("table"))
    hit = F.when(F.col("qualifier").isNotNull(), meant).otherwise(has)
    key = ["stmt", "pos", "block", "arm", "clause", "qualifier", "name"]
    found = near.groupBy(*key).agg(
        F.min_by(F.struct("table", "columns"), F.when(hit, F.col("hop"))).alias("t"), F.count("*").alias("n"), F.first("table").alias("only"), F.count_if(F.col("columns").isNull()).alias("open"),
    )
    table = F.coalesce("t.table", F.when(F.col("qualifier").isNull() & (F.col("n") == 1), F.col("only")))
    gone = F.when(F.col("qualifier").isNotNull(), F.col("t.columns").isNotNull() & ~F.array_contains("t.columns", F.col("name"))).otherwise(F.col("t").isNull() & (F.col("open") == 0))
    return found.select(*key, table.alias("table"), F.coalesce(gone, F.lit(False)).alias("missing"))


#: What is told of a statement: a finding, or, for R057, a column beside a source.
JUDGED = "rule string, detail string, pos int, block int, arm long, clause string, qualifier string, name string, hop int, table string, alias string"


def _judged(stmts: DataFrame, told: Column) -> DataFrame:
    """``(stmt, JUDGED)``: S001 and S002 of statements that ``told`` holds for, and what R057 asks of all but definitions; a statement is taken apart once."""
    plain = ~F.upper("text").rlike(r"^\s*(EXEC\s+SQL\s+)?(CREATE|ALTER|DROP|DECLARE\s+\S+\s+TABLE|GRANT|REVOKE|COMMENT|LABEL)\b")

    def judged(found: list[str], told: bool, plain: bool) -> list[tuple]:
        rows, nothing = _scoped(found) if told or plain else [], (None,) * 9
        out = [("S001", "*", *nothing)] if told and _starred(rows) else []
        out += [("S002", reason, *nothing) for _, reason in _slow(rows)] if told else []
        return out + [("R057", None, *x) for x in _met(rows)] if plain else out

    return each_row(_taken(stmts, told.alias("told"), plain.alias("plain")), "stmt", judged, JUDGED)


def _undeclared(near: DataFrame, stmts: DataFrame, variables: DataFrame | None) -> DataFrame:
    near = near.withColumnsRenamed({"name": "wanted", "table": "name"})
    # a file of known size: where it is small it is sent to the columns
    near = with_declarations(near, written(declared(stmts))).withColumnsRenamed({"name": "table", "wanted": "name"})
    found = _meant(near).filter("missing")
    found = found if variables is None else found.join(variables, ["stmt", "name"], "left_anti")
    place = F.concat(F.coalesce(F.element_at(F.split("table", r"\."), -1), F.lit("?")), F.lit("."), F.col("name"))
    return found.groupBy("stmt").agg(F.array_join(F.array_sort(F.collect_set(place)), ", ").alias("places"))


def undeclared_columns(stmts: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """R057: ``(stmt, places)`` - columns, as TABLE.COLUMN, that the declarations among the statements don't have. Names that a select list
    gives are passed over, and ``variables(stmt, name)`` of the routine around."""
    return _undeclared(_judged(stmts, F.lit(False)), stmts, variables)


def findings(stmts: DataFrame, variables: DataFrame | None = None, told: Column | None = None) -> DataFrame:
    """``(stmt, rule_id, detail)`` of S001, S002 and R057; the first two only of statements that ``told`` holds for."""
    rows = cut(_judged(stmts, F.lit(True) if told is None else told))
    return rows.filter("rule <> 'R057'").select("stmt", F.col("rule").alias("rule_id"), "detail").union(_undeclared(rows.filter("rule = 'R057'"), stmts, variables).select("stmt", F.lit("R057"), "places"))


def table_access(stmts: DataFrame) -> DataFrame:
    """``(stmt, table, letters)``: what a statement does to each table, in the order R C U D; ``?`` for what a dynamic statement does.

    The table that INSERT, UPDATE, DELETE, MERGE, LOCK and TRUNCATE name first is written, others are read; a table may be both. A MERGE writes
    what its branches say, an EXCLUSIVE lock counts as a change and a SHARE lock as a read.
    """
    said = stmts.withColumn("kind", statement_kind(F.col("text")))
    rows = tokens(stmts)
    found = sources(rows).filter("name is not null").drop("target")
    # where each source stands: the target is the first of the outermost block
    w = Window.partitionBy("stmt").orderBy("pos")
    order = rows.withColumns({"before": F.lag("word").over(w), "b2": F.lag("word", 2).over(w)}).filter("block = 0 and own and arm = 0")
    first = order.filter(F.col("before").isin("INTO", "UPDATE") | ((F.col("before") == "FROM") & (F.col("b2") == "DELETE"))).groupBy("stmt").agg(F.min_by("word", "pos").alias("head"), F.min("pos").alias("pos"))
    dotted = order.join(first.select("stmt", F.col("pos").alias("from_pos"), "head"), "stmt").filter(F.col("pos") == F.col("from_pos") + 2).withColumn("dot", F.col("before") == ".")
    target = first.join(dotted.select("stmt", "dot", F.col("word").alias("tail")), "stmt", "left").select("stmt", F.when(F.coalesce("dot", F.lit(False)), F.concat("head", F.lit("."), "tail")).otherwise(F.col("head")).alias("target"))
    branch = rows.filter("own and block = 0").withColumn("before", F.lag("word").over(w)).filter("before = 'THEN'").groupBy("stmt").agg(F.collect_set("word").alias("branches"))
    rows = found.join(said.select("stmt", "kind"), "stmt").join(target, "stmt", "left").join(branch, "stmt", "left")
    merged = F.array(*(F.when(F.array_contains("branches", word), letter) for word, letter in (("INSERT", "C"), ("UPDATE", "U"), ("DELETE", "D"))))
    merged = F.when(F.size(F.array_compact(merged)) > 0, F.array_compact(merged)).otherwise(F.array(F.lit("C"), F.lit("U")))
    write = F.when(F.col("kind") == "INSERT", F.array(F.lit("C"))).when(F.col("kind") == "UPDATE", F.array(F.lit("U"))).when(F.col("kind") == "DELETE", F.array(F.lit("D"))).when(F.col("kind") == "MERGE", merged)
    # one row a place that names the table: the first of the target is the write
    nth = F.row_number().over(Window.partitionBy("stmt", "name").orderBy("block", "arm"))
    rows = rows.withColumn("letters", F.when((F.col("name") == F.col("target")) & (nth == 1) & write.isNotNull(), write).otherwise(F.array(F.lit("R")))).select("stmt", F.col("name").alias("table"), F.explode("letters").alias("letter"))
    plain = F.upper(F.regexp_replace(F.trim("text"), r"\s+", " "))
    whole = r"^(LOCK TABLE|TRUNCATE TABLE|TRUNCATE) ([^ ;]+)"
    letter = F.when(~plain.startswith("LOCK"), "D").when(plain.contains(" EXCLUSIVE "), "U").otherwise("R")
    locks = said.filter(plain.rlike(whole)).select("stmt", F.regexp_extract(plain, whole, 2), letter)
    dynamic = said.filter("kind in ('PREPARE', 'EXECUTE', 'EXECUTE_IMMEDIATE')").select("stmt", F.lit("?"), F.lit("?"))
    every = rows.union(locks).union(dynamic).groupBy("stmt", "table").agg(F.collect_set("letter").alias("l"))
    return every.select("stmt", "table", F.when(F.array_contains("l", "?"), "?").otherwise(crud(F.col("l"))).alias("letters"))


def _starred(rows: list[Token]) -> bool:
    w, sets = _words(rows), ("UNION", "EXCEPT", "INTERSECT")
    # blocks that the statement is itself: not those of predicates, sources or WITH
    own = {0} | {t.pos for i, t in enumerate(rows, 6) if t.token == "(" and t.block == 0 and (w[i - 1] in (None, "FOR", *sets) or (w[i - 1] == "ALL" and w[i - 2] in sets))}
    arms = _arms(t for t in rows if t.own and t.block in own)
    return any(t.token == "*" and before.word in ("SELECT", "ALL", "DISTINCT") for arm in arms for before, t in pairwise(arm))


def select_star(tokens: DataFrame) -> DataFrame:
    """S001: ``(stmt)`` whose own select list, of any arm, is a star; T.* and the stars of subqueries are none."""
    return _each(tokens, lambda rows: [(1,)] if _starred(rows) else [], "n int").select("stmt")


class Predicate(NamedTuple):
    clause: str
    at: int
    left: list[Token]
    op: str
    right: list[Token]


def _predicates(rows: list[Token]) -> list[Predicate]:
    """Comparisons and LIKEs of WHERE and ON.

    A predicate lies between AND, OR, NOT and the words that begin clauses, on its block's own level or in brackets that
    hold predicates themselves.
    """
    out = []
    for arm in _arms(t for t in rows if t.clause in ("WHERE", "ON")):
        parts: list[list[Token]] = [[]]
        for t in arm:
            if t.word in ("AND", "OR", "NOT", "WHERE", "ON", "EXISTS"):
                parts.append([])
            else:
                parts[-1].append(t)
        for part in parts:
            i = next((i for i, t in enumerate(part) if t.word in COMPARISONS or t.word == "LIKE"), None)
            if i is not None:
                out.append(Predicate(part[0].clause, part[0].pos, part[:i], part[i].word, part[i + 1 :]))
    return out


def _holds_column(side: list[Token]) -> bool:
    return any(_named(t.token) and t.word not in RESERVED for t in side)


def _called(side: list[Token], others: tuple[str, ...]) -> bool:
    """Whether a side is a function over a column, its name none of ``others``."""
    head = side[0].token[0] if side else " "
    return (head == "_" or head.isalpha()) and side[0].word not in others and len(side) > 1 and side[1].token == "(" and _holds_column(side[2:])


def _open(side: list[Token]) -> int:
    """Brackets that open before the predicate."""
    return max(sum((t.token == "(") - (t.token == ")") for t in side), 0)


def _slow(rows: list[Token]) -> list[tuple[int, str]]:
    out = []
    for p in _predicates(rows):
        if p.clause != "WHERE":
            continue
        left = p.left[_open(p.left) :]
        if p.op == "LIKE":
            if p.right and p.right[0].token.startswith("'%"):
                out.append((p.at, "pattern"))
        elif _called(left, ("CASE", "CAST")):
            out.append((p.at, "function"))
        elif any(t.token in ("+", "-", "*", "/", "||") for t in left) and _holds_column(left):
            out.append((p.at, "arithmetic"))
    return out


def non_sargable(tokens: DataFrame) -> DataFrame:
    """S002: ``(stmt, at, reason)`` - predicates of WHERE whose left side is a function or arithmetic over a column, or a LIKE of a literal that begins with %."""
    return _each(tokens, _slow, "at int, reason string")


def unjoined(tokens: DataFrame) -> DataFrame:
    """R080: ``(stmt, block, arm)`` of SELECTs whose FROM lists tables with nothing to join them: no WHERE, JOIN or ON in that block."""
    own = tokens.filter("own").groupBy("stmt", "block", "arm").agg(F.collect_set("word").alias("words"), F.max((F.col("clause") == "FROM") & (F.col("token") == ",")).alias("listed"))
    return own.filter(F.col("listed") & F.array_contains("words", "SELECT") & ~F.arrays_overlap("words", F.array(*map(F.lit, ("WHERE", "JOIN", "ON"))))).select("stmt", "block", "arm")


def _sides(rows: list[Token]) -> list[tuple[int, str]]:
    out = []
    for p in _predicates(rows):
        side = None if p.op == "LIKE" else "left" if _called(p.left[_open(p.left) :], ("CASE",)) else "right" if _called(p.right, ("CASE",)) else None
        if side:
            out.append((p.at, side))
    return out


def function_on_column(tokens: DataFrame) -> DataFrame:
    """``(stmt, at, side)`` of comparisons in WHERE and ON of which a side is a function or CAST over a column; ``side`` is left or right, left first."""
    return _each(tokens, _sides, "at int, side string")
