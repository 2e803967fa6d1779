"""COBOL sources of fixed format as rows: tokens, data items, procedures and nested statements.

A source is cut into tokens by one expression over its text; divisions, sections, sentences and entries are told by a pass
over the tokens of a program. Scopes (END-IF, ELSE, WHEN, AT END ..., periods) need a stack: a small function over the same
tokens, which returns statement rows. This is a segmentation by reserved words, not a grammar: a word that isn't known is an operand.

Lines count from 1; columns 8 to 72 are read; comment lines (``*``, ``/``, ``D`` in column 7) and ``*>`` comments are passed
over; a literal or word goes on where column 7 holds ``-``. A source has one program.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.operators.graph import cut, dealt, each_group, each_row
from punchdeck.operators.operands import names

# Words that begin a statement.
VERBS = (
    "ACCEPT", "ADD", "ALTER", "CALL", "CANCEL", "CLOSE", "COMPUTE", "CONTINUE", "COPY", "DELETE", "DISPLAY", "DIVIDE", "ENTRY", "EVALUATE", "EXIT", "GENERATE", "GO", "GOBACK", "IF",
    "INITIALIZE", "INITIATE", "INSPECT", "INVOKE", "JSON", "MERGE", "MOVE", "MULTIPLY", "NEXT", "OPEN", "PERFORM", "READ", "RELEASE", "RETURN", "REWRITE", "SEARCH", "SET", "SORT",
    "START", "STOP", "STRING", "SUBTRACT", "SUPPRESS", "TERMINATE", "UNSTRING", "USE", "WRITE", "XML",
)
# Phrases of a statement that hold statements, by the word that tells them, and the verbs that take them.
PHRASES = {
    "END": ("READ", "RETURN", "SEARCH"), "SIZE": ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "COMPUTE"), "INVALID": ("READ", "WRITE", "REWRITE", "DELETE", "START"),
    "EXCEPTION": ("CALL", "ACCEPT", "DISPLAY", "INVOKE", "XML", "JSON"), "OVERFLOW": ("STRING", "UNSTRING", "CALL"), "EOP": ("WRITE",), "END-OF-PAGE": ("WRITE",),
}
# Words of USAGE, each with the name it is told by.
USAGES = {
    "COMP": "COMP", "COMPUTATIONAL": "COMP", "COMP-1": "COMP-1", "COMPUTATIONAL-1": "COMP-1", "COMP-2": "COMP-2", "COMPUTATIONAL-2": "COMP-2", "COMP-3": "COMP-3", "COMPUTATIONAL-3": "COMP-3",
    "COMP-4": "COMP", "COMPUTATIONAL-4": "COMP", "COMP-5": "COMP-5", "COMPUTATIONAL-5": "COMP-5", "BINARY": "COMP", "PACKED-DECIMAL": "COMP-3", "DISPLAY": "DISPLAY", "DISPLAY-1": "DISPLAY-1",
    "INDEX": "INDEX", "POINTER": "POINTER", "NATIONAL": "NATIONAL",
}
CLAUSES = ("PIC", "PICTURE", "REDEFINES", "OCCURS", "VALUE", "VALUES", "USAGE", "BLANK", "JUSTIFIED", "JUST", "SIGN", "SYNC", "SYNCHRONIZED", "GLOBAL", "EXTERNAL", "INDEXED", *USAGES)
DIVISIONS = ("IDENTIFICATION", "ID", "ENVIRONMENT", "DATA", "PROCEDURE")
DATA_SECTIONS = ("FILE", "WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE", "SCREEN", "REPORT", "COMMUNICATION")

#: A line begins with NEW, one that goes on with the line before begins with MORE.
NEW, MORE = "\n", "\x01"
_ON = f" *\n*{MORE}\\s*"
_WORD = r"[\p{L}\p{N}$#@&_][\p{L}\p{N}$#@&_-]*"
TOKEN = "|".join((
    rf"\*>[^\n{MORE}]*", rf'(?:[XNGBZxngbz])?"(?:[^"\n{MORE}]++|""|{_ON}")*+"?', rf"(?:[XNGBZxngbz])?'(?:[^'\n{MORE}]++|''|{_ON}')*+'?",
    r"(?i:EXEC\s+(?:SQL|CICS|DLI)\b)(?s:.*?)(?i:END-EXEC)", r"(?i:(?<=\s)PIC(?:TURE)?\s+(?:IS\s+)?)\S+?(?=[.,;]?(?:\s|$))",
    rf"[+-]?\d*\.?\d+(?![\p{{L}}\p{{N}}_-])", rf"{_WORD}(?:{_ON}[\p{{L}}\p{{N}}_-]+)*", r"\*\*|<=|>=|<>|[=<>+*/():.-]", rf"[\n{MORE}]+",
))


def _area(text: Column) -> Column:
    """What is read of each line, the lines marked by what they begin with."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1)
    mark = lambda x: F.substring(x, 7, 1)

    def one(pair: Column) -> Column:
        x = pair["x"]
        body = F.substring(x, 8, 65)
        body = F.when(mark(pair["behind"]) == "-", F.rpad(body, 65, " ")).otherwise(F.rtrim(body))
        return F.when((F.length(x) < 8) | mark(x).isin("*", "/", "D", "d"), NEW).when(mark(x) == "-", F.concat(F.lit(MORE), F.ltrim(body))).otherwise(F.concat(F.lit(NEW), body))

    # each line beside the next, so that nothing is looked up in the whole text for each line
    pairs = F.arrays_zip(lines.alias("x"), F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit(""))).alias("behind"))
    return F.array_join(F.transform(pairs, one), "")


def by_program() -> Window:
    return Window.partitionBy("program").orderBy("pos")


class Token(NamedTuple):
    line: int
    token: str
    word: str
    division: str | None


_BLANK = r"[ \t\n\x0b\f\r]"
_LITERAL_ON = re.compile(rf"(?<=[^\n{MORE}])\n*{MORE}{_BLANK}*[\"']")
_WORD_ON = re.compile(rf"(?<=[\w-]) *\n*{MORE}{_BLANK}*")
_QUOTED = re.compile(r"[XNGBZxngbz]?[\"']")


def _told(found: list[str]) -> list[tuple[int, Token]]:
    """One program's tokens with their places, without comments and the ends of lines."""
    rows, line = [], 0
    for pos, token in enumerate(found):
        marks = token.count(NEW) + token.count(MORE)
        # the ends of lines that follow each other are one token
        if token[0] not in (NEW, MORE) and token[:2] != "*>":
            shown = token
            # parts of a literal or word on several lines are put together
            if MORE in token:
                shown = (_LITERAL_ON if _QUOTED.match(token) else _WORD_ON).sub("", token)
            rows.append((pos, line, shown, shown.upper()))
        line += marks
    out, division = [], None
    for i, (pos, line, token, word) in enumerate(rows):
        if word in DIVISIONS and i + 1 < len(rows) and rows[i + 1][3] == "DIVISION":
            division = "IDENTIFICATION" if word == "ID" else word
        out.append((pos, Token(line, token, word, division)))
    return out


def _found(sources: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(program, found)``: the pieces of each source."""
    rows = sources.select(F.col(id_column).alias("program"), F.col(text_column).alias("text"))
    rows = dealt(rows, "program").select("program", _area(F.col("text")).alias("area"))
    return rows.select("program", F.regexp_extract_all("area", F.lit(f"({TOKEN})"), F.lit(1)).alias("found"))


def tokens(sources: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(program, pos, line, token, word, division)``; ``word`` is the token in upper case."""
    return each_row(_found(sources, id_column, text_column), "program", lambda found: [(pos, *t) for pos, t in _told(found)], "pos int, line int, token string, word string, division string")


def _by_program(tokens: DataFrame, run: Callable[[list[Token]], list[tuple]], columns: str) -> DataFrame:
    """What ``run`` returns for the tokens of each program."""
    return each_group(tokens.select("program", "pos", *Token._fields), "program", lambda c: run([Token(*x) for x in zip(*(c[n] for n in Token._fields), strict=True)]), columns, "pos")


def _after(words: Column, *names: str, skip: tuple[str, ...] = ("IS", "ARE")) -> Column:
    """The word behind the first of ``names`` that is there."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        at = F.array_position(words, n).cast("int")
        behind = F.get(words, at)
        out = F.when(at > 0, F.when(behind.isin(*skip), F.get(words, at + 1)).otherwise(behind)).otherwise(out)
    return out


def _entries(tokens: DataFrame, division: str) -> DataFrame:
    """``(program, entry, line, w)``: the words up to each period of a division."""
    rows = tokens.filter(F.col("division") == division).withColumn("entry", F.count_if(F.col("word") == ".").over(by_program().rowsBetween(Window.unboundedPreceding, -1)))
    return rows.filter("word <> '.'").groupBy("program", "entry").agg(F.min("line").alias("line"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("w"))


def files(tokens: DataFrame) -> DataFrame:
    """``(program, line, file, assign, status)``: the SELECTs of FILE-CONTROL."""
    w = F.col("w")
    rows = _entries(tokens, "ENVIRONMENT").filter(F.array_contains("w", "SELECT")).withColumn("w", F.slice("w", F.array_position("w", "SELECT").cast("int"), F.size("w")))
    name = F.when(w[1] == "OPTIONAL", F.get(w, F.lit(2))).otherwise(F.get(w, F.lit(1)))
    return rows.select("program", "line", name.alias("file"), _after(w, "ASSIGN", skip=("TO",)).alias("assign"), _after(w, "STATUS").alias("status"))


def records(tokens: DataFrame) -> DataFrame:
    """``(program, file, record)``: the records under each FD and SD."""
    rows = _entries(tokens, "DATA").withColumns({"head": F.col("w")[0], "name": F.get("w", F.lit(1))})
    w = Window.partitionBy("program").orderBy("entry")
    rows = rows.withColumn("file", F.last(F.when(F.col("head").isin("FD", "SD"), F.col("name")).when(F.col("name") == "SECTION", F.lit("")), ignorenulls=True).over(w))
    return rows.filter("head in ('1', '01') and file <> ''").select("program", "file", F.col("name").alias("record"))


LEVEL = re.compile(r"0?[1-9]|[1-4][0-9]|66|77|88")
PICTURE = re.compile(rf"PIC(TURE)?{_BLANK}")
PICTURE_WORDS = re.compile(rf"^PIC(TURE)?{_BLANK}+(IS{_BLANK}+)?")
ITEM = "idx int, line int, section string, level int, name string, picture string, usage string, occurs string, redefines string, value string, signed_apart boolean"


def _at(words: list[str], i: int) -> str | None:
    return words[i] if i < len(words) else None


def _behind(words: list[str], name: str) -> str | None:
    """The word behind the first of that name, without IS and ARE."""
    if name not in words:
        return None
    at = words.index(name) + 1
    return _at(words, at + 1) if _at(words, at) in ("IS", "ARE") else _at(words, at)


def _items(tokens: list[Token]) -> list[tuple]:
    """One program's data items, ``occurs`` as it is written."""
    out, entry, section = [], [], None
    rows = [t for t in tokens if t.division == "DATA"]
    for i, t in enumerate([*rows, None]):
        if t is not None:
            if t.word in DATA_SECTIONS and i + 1 < len(rows) and rows[i + 1].word == "SECTION":
                section = t.word
            if t.word != ".":
                entry.append((t, section))
                continue
        held, entry = entry, []
        words = [x.word for x, _ in held]
        if not words or not LEVEL.fullmatch(words[0]):
            continue
        second = _at(words, 1)
        named = second is not None and second not in CLAUSES and not PICTURE.match(second)
        picture = next((w for w in words if PICTURE.match(w)), None)
        usage = next((USAGES[w] for w in words if w in USAGES), None)
        at = words.index("OCCURS") + 1 if "OCCURS" in words else 0
        occurs = _at(words, at + 2) if _at(words, at + 1) == "TO" else None
        at = max(words.index(w) + 1 if w in words else 0 for w in ("VALUE", "VALUES"))
        given = at + (_at(words, at) in ("IS", "ARE"))
        out.append((
            len(out) + 1, held[0][0].line, held[-1][1], int(words[0]), second if named else "FILLER", PICTURE_WORDS.sub("", picture) or None if picture else None, usage, _behind(words, "OCCURS") if occurs is None else occurs,
            _behind(words, "REDEFINES"), held[given][0].token if at and given < len(held) else None, "SEPARATE" in words,
        ))
    return out


def data_items(tokens: DataFrame) -> DataFrame:
    """``(program, idx, line, section, level, name, picture, usage, occurs, redefines, value, signed_apart)``, ``idx`` from 1 in source order.

    Levels 66 and 88 are among them; ``occurs`` is the greatest number of times; a nameless item is ``FILLER``;
    ``value`` is as it is written, the first one of an 88.
    """
    return _by_program(tokens.filter("division = 'DATA'"), _items, ITEM).withColumn("occurs", F.col("occurs").try_cast("int"))


class Said(NamedTuple):
    """A token of the procedure division with what stands beside it; ``kind`` if it begins a procedure."""

    line: int
    token: str
    word: str
    sentence: int
    kind: str | None
    proc: int
    before: str | None
    behind: str | None
    then: str | None


NO_NAMES = frozenset((*VERBS, "END", "DECLARATIVES", "EJECT", "SKIP1", "SKIP2", "SKIP3"))


def _said(tokens: list[Token]) -> list[Said]:
    rows, out, sentence, proc = [t for t in tokens if t.division == "PROCEDURE"], [], 0, 0
    words = [t.word for t in rows] + [None, None]
    for i, t in enumerate(rows):
        before, word, behind, kind = words[i - 1] if i else None, t.word, words[i + 1], None
        if before == "." and behind in ("SECTION", ".") and word not in NO_NAMES and unicodedata.category(word[0])[0] in "LN":
            kind = "SECTION" if behind == "SECTION" else "PARAGRAPH"
            proc += 1
        out.append(Said(t.line, t.token, word, sentence, kind, proc, before, behind, words[i + 2]))
        sentence += word == "."
    return out


PROCEDURE = "idx int, name string, kind string, section string, line int"


def _procedures(said: list[Said]) -> list[tuple]:
    out, section = [], None
    for t in said:
        if t.kind:
            section = t.word if t.kind == "SECTION" else section
            out.append((t.proc, t.word, t.kind, section, t.line))
    return out


def procedures(tokens: DataFrame) -> DataFrame:
    """``(program, idx, name, kind, section, line)``: sections and paragraphs from 1 in source order; a section lies in itself."""
    return _by_program(tokens.filter("division = 'PROCEDURE'"), lambda t: _procedures(_said(t)), PROCEDURE)


STATEMENT = (
    "stmt int, line int, verb string, parent int, branch string, path array<int>, last int, branches array<string>, loop string, proc int, sentence long, words array<string>, text string"
)


def _nest(tokens: dict[str, list]) -> list[tuple]:
    """Statements of one program from its tokens and their ``event``: a stack of what is open.

    An open statement is [number, verb, branch]; without a branch the next verb ends it.
    """
    out: list[dict] = []
    stack: list[list] = []
    owner = None

    def nearest(verbs: tuple[str, ...], branch: str | None = None) -> list | None:
        """The innermost open statement of ``verbs``; all within it is closed."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][1] in verbs and (branch is None or stack[i][2] == branch):
                del stack[i + 1 :]
                return stack[i]
        return None

    def open_branch(frame: list | None, label: str) -> dict | None:
        if frame is None:
            return owner
        row = out[frame[0] - 1]
        # WHEN after WHEN without a statement between them: one branch
        if not (label.startswith("WHEN") and frame[2] and frame[2].startswith("WHEN") and row["last"] == frame[3]):
            row["branches"].append(label)
            frame[2] = label
        elif label == "WHEN OTHER":
            row["branches"][-1] = frame[2] = label
        frame[3] = len(out)
        row["last"] = max(row["last"], frame[3]) if frame[3] > row["stmt"] else row["last"]
        return row

    for event, word, token, line, proc, sentence in zip(*(tokens[c] for c in ("event", "word", "token", "line", "proc", "sentence")), strict=True):
        if event is None:
            if owner is not None:
                owner["words"].append(word)
                owner["tokens"].append(token)
            continue
        kind, _, label = event.partition(":")
        if kind == "verb":
            while stack and stack[-1][2] is None:
                stack.pop()
            verb = " ".join(word.split(None, 2)[:2]) if word.startswith("EXEC") else word
            owner = {
                "stmt": len(out) + 1, "line": line, "verb": verb, "parent": stack[-1][0] if stack else 0, "branch": stack[-1][2] if stack else None, "path": [f[0] for f in stack], "last": len(out) + 1,
                "branches": [], "loop": label or None, "proc": proc, "sentence": sentence, "words": [word], "tokens": [token],
            }
            out.append(owner)
            for f in stack:
                out[f[0] - 1]["last"] = owner["stmt"]
            first = "THEN" if word == "IF" else "BODY" if label else None
            if first:
                owner["branches"].append(first)
            stack.append([owner["stmt"], word, first, owner["stmt"]])
        elif kind == "period":
            stack, owner = [], None
        elif kind == "close":
            frame = nearest((label,))
            if frame is not None:
                stack.pop()
            owner = None
        elif kind == "else":
            owner = open_branch(nearest(("IF",), "THEN"), "ELSE")
        elif kind == "when":
            frame = nearest(("EVALUATE", "SEARCH"))
            owner = open_branch(frame, label or f"WHEN {1 + sum(b.startswith('WHEN') for b in out[frame[0] - 1]['branches'])}" if frame else "WHEN")
        else:
            owner = open_branch(nearest(PHRASES[label.split()[-1]]), label)
        if owner is not None and kind not in ("verb", "period", "close"):
            owner["words"].append(word)
            owner["tokens"].append(token)
    for row in out:
        row["text"] = " ".join(row.pop("tokens"))
    return [tuple(row.values()) for row in out]


VERB_SET = frozenset(VERBS)
ENDS = re.compile("END-(?!EXEC|OF)")
EXEC = re.compile(rf"EXEC{_BLANK}")


def _holds(t: Said) -> bool:
    """Whether a phrase that holds statements is told by this word."""
    if t.word == "END":
        return t.behind not in ("PROGRAM", "DECLARATIVES", "CLASS", "METHOD") and t.before not in (None, ".")
    return t.word in ("INVALID", "EXCEPTION", "OVERFLOW", "EOP", "END-OF-PAGE") or (t.word == "SIZE" and t.behind == "ERROR")


def _event(said: list[Said], i: int) -> str | None:
    """What a token opens or closes."""
    t = said[i]
    word, before, behind = t.word, t.before, t.behind
    embedded = EXEC.match(word) is not None
    if (word in VERB_SET and t.kind is None) or embedded:
        no = (word == "NEXT" and behind != "SENTENCE") or (word == "ENTRY" and before == "TO") or (word == "PERFORM" and before == "EXIT") or (word == "GENERATE" and before in ("XML", "JSON"))
        if not no:
            if word != "PERFORM":
                return "verb"
            if behind in ("UNTIL", "VARYING", "WITH", "TEST") or t.then == "TIMES":
                return "verb:until"
            return "verb:once" if behind is not None and (behind in VERB_SET or EXEC.match(behind)) else "verb"
    if word == ".":
        return "period"
    if word == "ELSE":
        return "else"
    if word == "WHEN":
        return "when:WHEN OTHER" if behind == "OTHER" else "when:"
    if ENDS.match(word):
        return "close:" + word[4:44]
    # a phrase begins with its first word: [NOT] [AT | ON] END
    next_holds = lambda k: i + k < len(said) and _holds(said[i + k])
    if word == "NOT":
        if next_holds(1):
            return f"phrase:NOT {behind}"
        return f"phrase:NOT {t.then}" if behind in ("AT", "ON") and next_holds(2) else None
    if word in ("AT", "ON"):
        return f"phrase:{behind}" if before not in (None, "NOT") and next_holds(1) else None
    return f"phrase:{word}" if before not in (None, "NOT", "AT", "ON") and _holds(t) else None


def _statements(said: list[Said]) -> list[tuple]:
    rows = [(t, _event(said, i)) for i, t in enumerate(said) if t.sentence > 0]
    cells = {c: [getattr(t, c) for t, _ in rows] for c in ("word", "token", "line", "proc", "sentence")}
    return _nest(cells | {"event": [e for _, e in rows]})


def statements(tokens: DataFrame) -> DataFrame:
    """Statements in source order, from 1: ``(program, stmt, line, verb, parent, branch, path, last, branches, loop, proc, sentence, words, text)``.

    ``parent`` is the statement that holds it (0: none) in its ``branch`` (THEN, ELSE, WHEN 1 ..., WHEN OTHER, BODY, END, NOT END, SIZE,
    ...), ``path`` all that hold it, ``last`` the last statement within it, ``branches`` those it opens. ``loop`` tells an inline PERFORM:
    ``until`` if it may repeat, else ``once``. ``words`` are its own, without those of statements in it; an EXEC block is one word.
    """
    return _by_program(tokens.filter("division = 'PROCEDURE'"), lambda t: _statements(_said(t)), STATEMENT)


def taken_apart(sources: DataFrame, id_column: str, text_column: str) -> dict[str, DataFrame]:
    """``items``, ``procedures`` and ``statements`` of sources, and ``parameters(program, name)``, the operands of PROCEDURE DIVISION USING:
    each source is taken apart once, where its row is, and what is told of it is written once."""
    kinds = {"items": ITEM, "procedures": PROCEDURE, "statements": STATEMENT, "parameters": "name string"}
    columns = list(dict.fromkeys(c for k in kinds.values() for c in k.split(", ")))
    place = {k: [columns.index(c) + 1 for c in v.split(", ")] for k, v in kinds.items()}

    def laid(kind: str, row: tuple) -> tuple:
        out = [kind] + [None] * len(columns)
        for i, x in zip(place[kind], row, strict=True):
            out[i] = x
        return tuple(out)

    def run(found: list[str]) -> list[tuple]:
        tokens = [t for _, t in _told(found)]
        said = _said(tokens)
        named = dict.fromkeys(t.word for t in said[: next((i for i, t in enumerate(said) if t.word == "."), len(said))] if t.word not in ("PROCEDURE", "DIVISION") and names(t.word))
        made = {"items": _items(tokens), "procedures": _procedures(said), "statements": _statements(said), "parameters": [(n,) for n in named]}
        return [laid(kind, row) for kind, rows in made.items() for row in rows]

    rows = cut(each_row(_found(sources, id_column, text_column), "program", run, ", ".join(("part string", *columns))))
    out = {k: rows.filter(F.col("part") == k).select("program", *(c.rsplit(" ", 1)[0] for c in v.split(", "))) for k, v in kinds.items()}
    return out | {"items": out["items"].withColumn("occurs", F.col("occurs").try_cast("int"))}
