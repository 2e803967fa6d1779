"""SQL scripts as statements: where one ends is told by a pass over the script's tokens, which are an array of its row.

A statement ends at the terminator in force, outside of literals, comments and compound statements. ``TERMINATOR @`` lines
(as ``--#SET TERMINATOR @`` or alone) name another from their end on. BEGIN and CASE open a block and END closes one with
its suffix; IF and loops count on neither side. A depth never falls below zero: it is the running sum of opening and
closing words less its lowest value so far. Scripts of card images - most lines reach byte column 73 and end in digits
by 80 - are read without those digits.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchdeck.operators.graph import cut, dealt, each_row

#: Stands in place of a directive's line, with the terminator behind it.
MARK = "\x02"
TOKEN = rf"({MARK}(?s:.)|--[^\n]*|/\*(?s:.*?)(?:\*/|\z)|'(?:[^']++|'')*+'?|\"(?:[^\"]++|\"\")*+\"?|\n|[^\S\n]+|[\p{{L}}_][\p{{L}}\p{{N}}_]*|\p{{N}}[\p{{L}}\p{{N}}_]*|(?s:.))"
#: Characters of blank tokens.
BLANK = " \t\n\x0b\f\r"
MARKED = re.compile(f"{MARK}.", re.S)
SUFFIXES = ("IF", "WHILE", "FOR", "LOOP", "REPEAT", "CASE")
#: Words that say something of where statements and bodies begin and end.
TOLD = frozenset(("BEGIN", "END", "ATOMIC", "NOT", *SUFFIXES))


def directive(line: Column) -> Column:
    """The terminator that a line names: ``TERMINATOR x`` alone, or behind SET in a comment; else null."""
    said = F.upper(F.trim(line))
    words = F.filter(F.split(F.regexp_replace(F.ltrim(F.regexp_replace(said, "^--", "")), "^#", ""), r"\s+"), lambda w: w != "")
    head = F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")
    wanted = F.when(said.startswith("--"), "SET TERMINATOR").otherwise("TERMINATOR")
    sign = F.element_at(F.split(F.trim(line), r"\s+"), -1)
    return F.when((F.size(words) > 1) & (head == wanted) & (F.length(sign) == 1), sign)


def _numbered(line: Column) -> Column:
    """How many digits a card image ends in, 0 for other lines; a wide character over column 72 belongs to the content."""
    size = F.octet_length(line)
    digits = F.length(F.regexp_extract(line, r"([0-9]*)$", 1))
    wide = lambda k: F.octet_length(F.substring(line, F.length(line) - k, 1)) > 1
    area = size - 72
    return F.when((size < 73) | (size > 80), 0).when(digits >= area, area).when((area > 1) & (digits == area - 1) & wide(area - 1), area - 1).otherwise(0)


def _prepared(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` as it is read. A step for a column: what a function over an array holds is computed wherever it is named."""
    text = F.col("text")
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1), lambda x: F.struct(x.alias("x"), _numbered(x).alias("n")))
    rows = rows.withColumn("lines", lines)
    rows = rows.withColumn("cards", F.size(F.filter("lines", lambda x: x["n"] > 0)) * 2 > F.size(F.filter("lines", lambda x: F.trim(x["x"]) != "")))
    bare = lambda x: F.when(x["n"] > 0, F.rpad(F.substring(x["x"], F.lit(1), F.length(x["x"]) - x["n"]), F.length(x["x"]), " ")).otherwise(x["x"])
    # few lines hold the word at all
    said = lambda x: F.contains(F.upper(x), F.lit("TERMINATOR")) & directive(x).isNotNull()
    marked = lambda x: F.when(said(x), F.rpad(F.concat(F.lit(MARK), directive(x)), F.length(x), " ")).otherwise(x)
    # asked once for the text, not for each line
    shown = F.when(F.col("cards"), F.transform("lines", lambda x: marked(bare(x)))).otherwise(F.transform("lines", lambda x: marked(x["x"])))
    return rows.withColumn("text", F.array_join(shown, "\n")).drop("lines", "cards")


def _taken(scripts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(script, found)``: the tokens of each script."""
    rows = scripts.select(F.col(id_column).alias("script"), F.col(text_column).alias("text"))
    return _prepared(dealt(rows, "script")).select("script", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1)).alias("found"))


class Token(NamedTuple):
    """A token that is more than blanks and comments."""

    pos: int
    token: str
    word: str | None
    term: str
    step: int
    depth: int
    word_before: str | None


def _joins(token: str, term: str) -> bool:
    """Whether a word beside the token is a part of a longer name."""
    return (token in ("@", "#", "$") and token != term) or token[0] == "_" or unicodedata.category(token[0])[0] in "LN"


def _said(found: list[str], every: bool = False) -> list[Token]:
    """What one script says, with what is told of it; words that begin and end nothing only if ``every`` is wanted."""
    out, term, most = [], ";", len(found) - 1
    for i, t in enumerate(found):
        head = t[0]
        if head in BLANK:
            continue
        if head == MARK:
            term = t[1:2]
        elif t[:2] not in ("--", "/*"):
            word = None
            if head == "_" or head.isalpha():
                word = t.upper()
                # a word beside a character of names is a part of a longer name, unless that character ends statements
                if not (every or word in TOLD) or (i and _joins(found[i - 1], term)) or (i < most and _joins(found[i + 1], term)):
                    word = None
            out.append((i, t, word, term))
    words, total, least, rows, before = [r[2] for r in out], 0, 0, [], None
    words.append(None)
    for k, r in enumerate(out):
        word, step = words[k], 0
        if word in ("BEGIN", "CASE"):
            step = 0 if word == "CASE" and before == "END" else 1
        elif word == "END":
            step = 0 if words[k + 1] in SUFFIXES[:-1] else -1
        if step:
            total += step
            least = min(least, total)
        rows.append(Token(*r, step, total - least, before))
        before = word
    return rows


def _placed(found: list[str]) -> list[tuple[int, int, int]]:
    """Where each token's first character stands: place, line, column."""
    out, at, line, first = [], 0, 1, 0
    for t in found:
        out.append((at, line, at - first + 1))
        if "\n" in t:
            line += t.count("\n")
            first = at + t.rindex("\n") + 1
        at += len(t)
    return out


def _marked(found: list[str]) -> list[tuple]:
    said, out, term, depth = {t.pos: t for t in _said(found, every=True)}, [], ";", 0
    for i, (token, place) in enumerate(zip(found, _placed(found), strict=True)):
        t = said.get(i)
        term, depth = token[1:2] if token[0] == MARK else term, t.depth if t else depth
        out.append((i, *place, token, t and t.word, t is not None, term, t.step if t else 0, depth, t and t.word_before))
    return out


def tokens(scripts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(script, pos, at, line, col, token, word, says, term, step, depth, word_before)``: ``at`` is the place of the first character, ``says`` whether
    it is more than blanks and comments, ``depth`` how many compound statements are open behind it."""
    columns = "pos int, at long, line int, col int, token string, word string, says boolean, term string, step int, depth long, word_before string"
    return each_row(_taken(scripts, id_column, text_column), "script", _marked, columns)


def _split(found: list[str]) -> list[tuple]:
    """Number, text and ends of each statement, from its first token that says something to its last."""
    out, first, last, place = [], None, None, None
    for t in [*_said(found), None]:
        if t is not None and not (t.depth == 0 and t.token == t.term):
            first, last = t.pos if first is None else first, t.pos
            continue
        if first is not None:
            place = place or _placed(found)
            text = "".join(MARKED.sub("  ", x) if MARK in x else x for x in found[first : last + 1])
            _, line, col = place[last]
            breaks, tail = found[last].count("\n"), len(found[last]) - found[last].rfind("\n") - 1
            out.append((len(out) + 1, text, *place[first][1:], line + breaks, tail if breaks else col + tail - 1))
        first = None
    return out


def statements(scripts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(script, nth, text, line, col, end_line, end_col)``: the statements of each script, from 1; lines and columns from 1.

    ``text`` is the script's own, without the terminator and the comments before and behind it.
    """
    return each_row(_taken(scripts, id_column, text_column), "script", _split, "nth int, text string, line int, col int, end_line int, end_col int")


def _body(found: list[str]) -> list[tuple]:
    """What stands in the first outermost block of one statement, and how many lines below."""
    rows = _said(found)
    first = next((k for k, t in enumerate(rows) if t.step == 1 and t.depth == 1 and (t.word == "BEGIN" or (t.word == "CASE" and k == 0))), None)
    close = None if first is None else next((k for k in range(first + 1, len(rows)) if rows[k].step == -1 and rows[k].depth == 0), None)
    if close is None:
        return []
    # ATOMIC and NOT ATOMIC go with BEGIN
    words = [t.word for t in rows[first + 1 : first + 3]]
    skip = 1 if words[:1] == ["ATOMIC"] else 2 if words == ["NOT", "ATOMIC"] else 0
    start, end = rows[first + skip + 1].pos if skip else rows[first].pos + 1, rows[close].pos
    return [("".join(found[start:end]), "".join(found[:start]).count("\n"))] if start < end else []


def bodies(statements: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, text, more)``: what stands between the first outermost BEGIN of each statement - or a CASE that it begins with - and
    the END of it, and how many lines below the statement's first it starts."""
    found = each_row(_taken(statements.select(F.struct(*key).alias("id"), "text"), "id", "text"), "script", _body, "text string, more int")
    return found.select("script.*", "text", "more")


def nested(scripts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(script, path, text, line)``: statements at every depth of compound statements; ``path`` holds their numbers from the outermost.

    A round for each depth of nesting.
    """
    top = statements(scripts, id_column, text_column)
    out = front = cut(top.select("script", F.array("nth").alias("path"), "text", "line"))
    while True:
        inner = bodies(front.filter(F.upper("text").rlike(r"\b(BEGIN|CASE)\b")), ["script", "path", "line"])
        parts = statements(inner.select(F.struct("script", "path", (F.col("line") + F.col("more")).alias("base")).alias("id"), "text"), "id", "text")
        front = cut(parts.select("script.script", F.concat("script.path", F.array("nth")).alias("path"), "text", (F.col("script.base") + F.col("line") - 1).cast("int").alias("line")))
        if front.isEmpty():
            return out
        out = out.union(front)


ROUTINE = r'(?is)^CREATE\s+(?:OR\s+REPLACE\s+)?(PROCEDURE|FUNCTION|TRIGGER)\s+("[^"]+"|[^\s(]+)'


def routines(nested: DataFrame) -> DataFrame:
    """``(script, nth, kind, name, line, n_statements)``: routines that the outermost statements of ``nested`` define, and how many
    statements their bodies hold at all depths."""
    top = F.size("path") == 1
    plain = F.regexp_replace("text", r"--[^\n]*|/\*(?s:.*?)\*/", " ")
    kind, name = (F.upper(F.regexp_extract(plain, ROUTINE, g)) for g in (1, 2))
    found = nested.groupBy("script", F.col("path")[0].alias("nth")).agg(F.max(F.when(top, kind)).alias("kind"), F.max(F.when(top, name)).alias("name"), F.max(F.when(top, F.col("line"))).alias("line"), F.count_if(~top).alias("n_statements"))
    return found.filter("kind <> ''")


def variables(nested: DataFrame) -> DataFrame:
    """``(script, nth, name)``: parameters and declared variables of each routine, in upper case."""
    plain = F.upper(F.regexp_replace("text", r"--[^\n]*|/\*(?s:.*?)\*/", " "))
    head = F.regexp_extract_all(F.regexp_extract(plain, r"(?s)^CREATE\s+(?:OR\s+REPLACE\s+)?(?:PROCEDURE|FUNCTION|TRIGGER)\s(.*?)(?:\bBEGIN\b|\z)", 1), F.lit(r"\b(?:IN|OUT|INOUT)\s+([\p{L}_][\p{L}\p{N}_]*)"), F.lit(1))
    listed = F.split(F.regexp_extract(plain, r"(?s)^\s*DECLARE\s+([\p{L}_][\p{L}\p{N}_]*(?:\s*,\s*[\p{L}_][\p{L}\p{N}_]*)*)", 1), r"\s*,\s*")
    rows = nested.select("script", F.col("path")[0].alias("nth"), F.explode_outer(F.when(F.size("path") == 1, head).otherwise(listed)).alias("name"))
    return rows.filter("name <> ''").distinct()


def unclosed_literals(scripts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(script, line)`` of a literal without a closing quote: what stands behind it is lost."""
    rows = tokens(scripts, id_column, text_column).filter(F.col("token").rlike(r"""^['"]"""))
    open_ = ~F.col("token").rlike(r"""^(?s:'(?:[^']|'')*'|"(?:[^"]|"")*")$""")
    return rows.filter(open_).groupBy("script").agg(F.min("line").alias("line"))
