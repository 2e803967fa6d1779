"""Definitions and uses of names in statements: each word of a statement has the role of the phrase it stands in.

Roles are a table of verbs and phrases; a word's phrase is the last one told in its statement. Subscripts and
reference modifications are uses wherever they stand; the word behind OF or IN, a procedure's name and literals are none.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchdeck.operators.graph import each_row

# For each verb its phrases (the verb's own first) with what the names behind them are: D defined, U used, B both,
# 1 the first name defined, 2 the first name both, 3 the first name used, - none. Behind GIVING: what a phrase is if the statement has GIVING.
ROLES = {
    "MOVE": "MOVE U TO D", "SET": "SET D TO U UP U DOWN U BY U", "COMPUTE": "COMPUTE D = U", "ADD": "ADD U TO B/U GIVING D", "SUBTRACT": "SUBTRACT U FROM B/U GIVING D",
    "MULTIPLY": "MULTIPLY U BY B/U GIVING D", "DIVIDE": "DIVIDE U INTO B/U BY U GIVING D REMAINDER D", "INITIALIZE": "INITIALIZE D REPLACING U", "READ": "READ - INTO 1 KEY 3",
    "RETURN": "RETURN - INTO 1", "ACCEPT": "ACCEPT 1 FROM -", "DISPLAY": "DISPLAY U UPON -", "STRING": "STRING U INTO D WITH - POINTER 2 OVERFLOW -",
    "UNSTRING": "UNSTRING U INTO D TALLYING D WITH - POINTER 2 OVERFLOW -", "CALL": "CALL U USING U RETURNING 1 GIVING 1", "PERFORM": "PERFORM - VARYING 1 AFTER 1 FROM U BY U UNTIL U TIMES -",
    "GO": "GO - DEPENDING U", "INSPECT": "INSPECT B TALLYING D FOR U REPLACING U CONVERTING U", "ALTER": "ALTER -", "STOP": "STOP -", "EXIT": "EXIT -", "COPY": "COPY -", "USE": "USE -", "NEXT": "NEXT -",
    "SORT": "SORT - KEY U", "MERGE": "MERGE - KEY U", "OPEN": "OPEN -", "CLOSE": "CLOSE -", "CONTINUE": "CONTINUE -", "GOBACK": "GOBACK -", "CANCEL": "CANCEL U", "DELETE": "DELETE -", "START": "START - KEY U",
}
# Reserved words that stand among operands.
RESERVED = (
    "ADVANCING", "AFTER", "ALL", "ALPHABETIC", "ALPHABETIC-LOWER", "ALPHABETIC-UPPER", "ALPHANUMERIC", "ALSO", "AND", "ANY", "ARE", "ASCENDING", "AT", "BEFORE", "BY", "CHARACTERS",
    "CONTENT", "CONVERTING", "CORR", "CORRESPONDING", "COUNT", "CYCLE", "DATE", "DAY", "DAY-OF-WEEK", "DELIMITED", "DELIMITER", "DEPENDING", "DESCENDING", "DOWN", "ELSE", "END", "ENTRY",
    "EQUAL", "EQUALS", "ERROR", "EXCEPTION", "FALSE", "FIRST", "FOR", "FROM", "FUNCTION", "GIVING", "GREATER", "HIGH-VALUE", "HIGH-VALUES", "I-O", "IN", "INITIAL", "INPUT", "INTO", "INVALID", "IS",
    "KEY", "LEADING", "LENGTH", "LESS", "LINE", "LINES", "LOW-VALUE", "LOW-VALUES", "MODE", "NEGATIVE", "NEXT", "NO", "NOT", "NULL", "NULLS", "NUMERIC", "OF", "OFF", "OMITTED", "ON", "OR", "OTHER",
    "OUTPUT", "OVERFLOW", "PAGE", "POINTER", "POSITIVE", "PROCEDURE", "PROCEED", "PROGRAM", "QUOTE", "QUOTES", "RECORD", "REFERENCE", "REMAINDER", "REPLACING", "RETURNING", "ROUNDED", "RUN",
    "SENTENCE", "SIZE", "SPACE", "SPACES", "TALLYING", "TEST", "THAN", "THEN", "THROUGH", "THRU", "TIME", "TIMES", "TO", "TRAILING", "TRUE", "UNTIL", "UP", "UPON", "USING", "VALUE", "VARYING", "WHEN", "WITH",
    "ZERO", "ZEROES", "ZEROS",
)
RESERVED_SET = frozenset(RESERVED)


def is_name(word: Column) -> Column:
    return word.rlike(r"^[\p{L}\p{N}_$#@-]*\p{L}[\p{L}\p{N}_$#@-]*$") & ~word.isin(*RESERVED)


ASCII_NAME = re.compile(r"[A-Z0-9_$#@-]*[A-Z][A-Z0-9_$#@-]*")


def names(word: str) -> bool:
    """``is_name`` of one word."""
    if word in RESERVED_SET:
        return False
    return ASCII_NAME.fullmatch(word) is not None or (any(map(str.isalpha, word)) and all(c in "_$#@-" or unicodedata.category(c)[0] in "LN" for c in word))


#: The roles of ``ROLES`` by verb and phrase.
TABLE = {(v, name): role for v, line in ROLES.items() for name, role in zip(line.split()[::2], line.split()[1::2], strict=True)}


def named(verb: str, words: list[str]) -> list[tuple[str, bool, bool]]:
    """``(name, defined, used)``: the names in one statement, each once."""
    out: dict[str, list[bool]] = {}
    gives, depth, phrase, seen = "GIVING" in words, 0, None, set()
    for i, word in enumerate(words):
        depth += (word == "(") - (word == ")")
        if depth == 0 and (verb, word) in TABLE:
            phrase = (i, word)
        # FUNCTION NAME and the qualifier behind OF or IN are no operands
        if not i or not names(word) or words[i - 1] in ("OF", "IN", "FUNCTION"):
            continue
        role = TABLE.get((verb, phrase[1]), "U") if phrase else "U"
        if "/" in role:
            role = role[2] if gives else role[0]
        if verb == "PERFORM" and words[i + 1 : i + 2] == ["TIMES"]:
            role = "U"
        inside = depth > 0
        once = (phrase, inside) not in seen
        seen.add((phrase, inside))
        held = out.setdefault(word, [False, False])
        held[0] |= not inside and (role in ("D", "B") or (role in ("1", "2") and once))
        held[1] |= inside or role in ("U", "B") or (role in ("2", "3") and once)
    # a loop's own variables are set before they are tested
    return [(name, defined, used and not (defined and verb == "PERFORM")) for name, (defined, used) in out.items() if defined or used]


def operands(stmts: DataFrame) -> DataFrame:
    """``(program, node, name, defined, used)``: the names in each statement of ``punchdeck.sources.cobol``, each once."""
    simple = stmts.filter("verb not like 'EXEC %'").select(F.struct("program", F.col("stmt").alias("node")).alias("at"), "verb", "words")
    return each_row(simple, "at", named, "name string, defined boolean, used boolean").select("at.*", "name", "defined", "used").union(embedded(stmts))


def embedded(stmts: DataFrame) -> DataFrame:
    """Host variables of EXEC SQL (those between INTO and FROM are defined) and names in the options of EXEC CICS."""
    text = F.upper("text")
    sql = F.col("verb") == "EXEC SQL"
    host = r":\s*([\p{L}][\p{L}\p{N}_-]*)"
    into = F.when(sql & ~text.rlike(r"(?s)^EXEC\s+SQL\s+INSERT\b"), F.regexp_extract_all(F.regexp_extract(text, r"(?s)\bINTO\s+(:.*?)(?:\bFROM\b|\bEND-EXEC|$)", 1), F.lit(host), F.lit(1)))
    every = F.when(sql, F.regexp_extract_all(text, F.lit(host), F.lit(1)))
    option = lambda names: F.regexp_extract_all(text, F.lit(rf"(?s)\b(?:{names})\s*\(\s*([\p{{L}}][\p{{L}}\p{{N}}-]*)"), F.lit(1))
    cics = F.col("verb") == "EXEC CICS"
    gets = F.when(cics, option("INTO|RESP2?|LENGTH|SET")).otherwise(into)
    gives = F.when(cics, option("FROM|RIDFLD|COMMAREA|QUEUE|PROGRAM|TRANSID|FILE|DATASET|LENGTH|KEYLENGTH")).otherwise(F.array_except(every, F.coalesce(into, F.array().cast("array<string>"))))
    rows = stmts.filter("verb like 'EXEC %'").select("program", F.col("stmt").alias("node"), F.array_distinct(gets).alias("d"), F.array_distinct(gives).alias("u"))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"d": F.coalesce("d", none), "u": F.coalesce("u", none)})
    return rows.select("program", "node", "d", "u", F.explode(F.array_union("d", "u")).alias("name")).select("program", "node", "name", F.array_contains("d", F.col("name")), F.array_contains("u", F.col("name")))


def definitions(found: DataFrame) -> DataFrame:
    return found.filter("defined").select("program", "node", "name")


def uses(found: DataFrame) -> DataFrame:
    return found.filter("used").select("program", "node", "name")


def external_inputs(stmts: DataFrame) -> DataFrame:
    """``(program, node, name)``: names that take input from outside: of ACCEPT, and INTO of EXEC CICS RECEIVE."""
    text = F.upper("text")
    name = F.when(F.col("verb") == "ACCEPT", F.get("words", F.lit(1))).when(
        (F.col("verb") == "EXEC CICS") & text.rlike(r"(?s)^EXEC\s+CICS\s+RECEIVE\b"), F.nullif(F.regexp_extract(text, r"(?s)\bINTO\s*\(\s*([\p{L}][\p{L}\p{N}-]*)", 1), F.lit(""))
    )
    return stmts.select("program", F.col("stmt").alias("node"), name.alias("name")).filter(is_name(F.col("name")))
