"""Secrets in texts: patterns, and values in a credential's place that are costly to guess.

Three patterns give spans of their own (``assign``, ``access``, ``hex``; a span is the whole match). Besides, whatever
stands as the value of a credential (``pwd: ...``, ``passphrase is ...``, quoted or not) is judged by the cost of guessing it:
a dynamic programme over its characters finds the cheapest way to put it together from words, dates, repeats, walks
over the keyboard and characters tried one by one, as sums of log10 of the guesses of each part. Values of ``least`` or
more that overlap no pattern's span are spans of kind ``guess``; cheap ones, as placeholders and names are, are not.

A word costs its rank among the words of all the texts given: they are counted by one aggregation, and the ``words``
most frequent make the dictionary (a model of bounded size, sent to each worker; a rarer word is tried by characters).
Texts are then scanned in one narrow stage.

Cases: a null text counts as empty; a text is scanned whole, however long it or a value is, at a cost in proportion to
its length; repeated rows and ids are each scanned for themselves; words of one count are ordered by themselves,
and chosen by a hash where not all fit; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchdeck.llm.common import by_bytes, lean, near_hash, small_batches, text_or_empty, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{32,}")
#: Names of credentials; a text that holds none of ``STEMS`` in lower case holds no name and no key word of ``ASSIGN``.
STEMS = ("pass", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "authorization", "private", "access")
NAMES = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|authorization|(?:private|access|secret)[_-]?key"
CONTEXT = re.compile(rf"""(?ai)(?<![a-z])(?:{NAMES})["'`]?[\x20\t]*(?:=>|:=|[:=]|\bis\b)[\x20\t]*(?:(?:bearer|basic)[\x20]+)?(?:"([^"\n]+)"|'([^'\n]+)'|`([^`\n]+)`|([^\s"'`,;<>()]+))""")

BATCH_BYTES = 2 << 20
#: log10 of the guesses from which a value is a secret, and of the choice between ways at each part.
LEAST, PART = 10.0, math.log10(2)
#: Lengths of the dictionary's words.
SHORTEST, LONGEST = 3, 20

# Keys of a US keyboard by row, without and with shift.
KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")
#: How far each row stands to the right of the first.
STAGGER = (0.0, 1.5, 1.75, 2.25)
PLACE = {c: (y, x + STAGGER[y]) for rows in (KEYS, SHIFTED) for y, row in enumerate(rows) for x, c in enumerate(row)}
N_KEYS = sum(map(len, KEYS))
DATES = [re.compile("(?a)" + p) for p in (r"(?P<y>\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})", r"(\d{1,2})([-/._]?)(\d{1,2})\2(?P<y>\d{4})", r"(\d{1,2})([-/._]?)(\d{1,2})\2(?P<y>\d{2})")]


def character_cost(c: str) -> float:
    if "0" <= c <= "9":
        return 1.0
    return math.log10(26) if "a" <= c <= "z" or "A" <= c <= "Z" else math.log10(33) if c < "\x80" else 2.0


def case_cost(word: str) -> float:
    upper = sum("A" <= c <= "Z" for c in word)
    if not upper:
        return 0.0
    return math.log10(2) if upper == len(word) or "A" <= word[0] <= "Z" and upper == 1 else math.log10(math.comb(len(word), upper) + 1)


def real(year: int, month: int, day: int) -> bool:
    try:
        return bool(datetime.date(year, month, day))
    except ValueError:
        return False


def date_parts(value: str) -> Iterator[tuple[int, int, float]]:
    """Starts, ends and costs of calendar dates, day and month in either order."""
    for i in (i for i, c in enumerate(value) if "0" <= c <= "9"):
        for m in filter(None, (p.match(value, i) for p in DATES)):
            year = int(m["y"]) + (0 if len(m["y"]) == 4 else 1900 if m["y"] > "50" else 2000)
            a, b = (int(m[g]) for g in (1, 3, 4) if m.span(g) != m.span("y"))
            if real(year, a, b) or real(year, b, a):
                yield i, m.end(), math.log10(365 * max(20, abs(year - 2000))) + (math.log10(4) if m[2] else 0.0)


def repeat_parts(value: str, rank: Mapping[str, int], most: int = 8) -> Iterator[tuple[int, int, float]]:
    """Stretches that repeat a unit of up to ``most`` characters, from where they start to the end of each repetition."""
    for unit in range(1, most + 1):
        start = 0
        for i in range(len(value) - unit + 1):
            if i + unit == len(value) or value[i] != value[i + unit]:
                times = (i - start + unit) // unit
                least = 3 if unit == 1 else 2
                if times >= least:
                    one = guess_cost(value[start : start + unit], rank)
                    yield from ((start, start + k * unit, one + math.log10(k)) for k in range(least, times + 1))
                start = i + 1


def walk_parts(value: str, shortest: int = 4) -> Iterator[tuple[int, int, float]]:
    """Stretches of keys each beside the last, from where they start to each end; a change of direction costs a choice."""
    start, turns, way, shifts = 0, 0, None, 0
    for i in range(1, len(value) + 1):
        step = None
        if i < len(value):
            (y, x), (v, u) = PLACE.get(value[i - 1], (9, 9)), PLACE.get(value[i], (-9, -9))
            if abs(v - y) <= 1 and (abs(u - x) == 1 if v == y else abs(u - x) < 1):
                step = (v - y, u > x)
        if step is None:
            start, turns, way, shifts = i, 0, None, 0
            continue
        turns, way = turns + (way is not None and step != way), step
        shifts += any(value[i] in row for row in SHIFTED)
        if i + 1 - start >= shortest:
            yield start, i + 1, math.log10(N_KEYS * (i + 1 - start)) + (turns + 1) * math.log10(4) + (math.log10(2) * min(shifts, i + 1 - start - shifts) + PART if shifts else 0.0)


def guess_cost(value: str, rank: Mapping[str, int]) -> float:
    """log10 of the guesses of the cheapest way to put ``value`` together."""
    costs, low = [character_cost(c) for c in value], "".join(c.lower() if c < "\x80" else c for c in value)
    parts: dict[int, list[tuple[int, float]]] = {}
    for found in (date_parts(value), repeat_parts(value, rank), walk_parts(value)):
        for start, end, cost in found:
            parts.setdefault(start, []).append((end, cost + PART))
    best = [0.0] + [math.inf] * len(value)
    for i, c in enumerate(costs):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + c)
        for end, cost in parts.get(i, ()):
            best[end] = min(best[end], here + cost)
        if "a" <= low[i] <= "z":
            for end in range(i + SHORTEST, min(i + LONGEST, len(value)) + 1):
                at = rank.get(low[i:end])
                if at:
                    best[end] = min(best[end], here + math.log10(at) + case_cost(value[i:end]) + PART)
    return best[-1]


def base_spans(text: str, named: bool) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' matches; ``named``: whether the text may hold a name of a credential."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if named else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def scan(text: str, rank: Mapping[str, int], least: float = LEAST) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float]]:
    """Spans of the patterns, spans that the guess cost adds, and the cost of each value in a credential's place."""
    low = text.lower()
    named = any(s in low for s in STEMS)
    base, added, costs = base_spans(text, named), [], []
    at, reach = 0, 0
    for m in CONTEXT.finditer(text) if named else ():
        start, end = m.span(m.lastindex)
        while end > start and text[end - 1] in ".!?:":
            end -= 1
        if end > start:
            costs.append(guess_cost(text[start:end], rank))
            while at < len(base) and base[at][0] < end:
                reach, at = max(reach, base[at][2]), at + 1
            if costs[-1] >= least and reach <= start:
                added.append((start, 3, end))
    return base, added, costs


def frequent_words(documents: DataFrame, words: int, text_column: str = "text") -> dict[str, int]:
    """Ranks from 1 of the ``words`` most frequent words of ASCII letters of all texts.

    Words are first numbered by classes of their counts; only the last class that has room is cut, by a hash, so that
    the driver gets the words themselves and about as many again, however many partitions count them.
    """
    found = documents.select(F.explode(F.split(F.lower(text_or_empty(text_column)), "[^a-z]+")).alias("word"))
    found = found.filter(F.length("word").between(SHORTEST, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))
    found = written(found.withColumn("class", F.floor(F.log2("n") * 8)), "words")
    chosen, cut = [], None
    for r in found.groupBy("class").count().orderBy(F.desc("class")).collect():  # at most 8 times 63
        cut = r
        if r["count"] > words - sum(c["count"] for c in chosen):
            break
        chosen.append(r)
        cut = None
    top = found.filter(F.col("class").isin([r["class"] for r in chosen])).collect()
    if cut and len(top) < words:
        top += near_hash(found.filter(F.col("class") == cut["class"]), words - len(top), cut["count"], "word").collect()
    return {r.word: i for i, r in enumerate(sorted(top, key=lambda r: (-r.n, r.word)), 1)}


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


Row = tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float]]


def scanned(documents: DataFrame, out: Callable[[int | None, str, Row], list[tuple]], schema: pa.Schema, words: int, least: float, id_column: str, text_column: str) -> DataFrame:
    spark = documents.sparkSession
    rank = spark.sparkContext.broadcast(frequent_words(documents, words, text_column))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            rows = [r for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in out(i, t, scan(t, rank.value, least))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    small_batches(spark)
    rows = documents.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    names = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return rows.mapInArrow(lean(task), ", ".join(f"`{f.name}` {names[f.type]}" for f in schema))


def spans(documents: DataFrame, words: int = 50_000, least: float = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, kind, start, stop, secret)``: a row for each span, in code points."""

    def out(key: int | None, text: str, row: Row) -> list[tuple]:
        return [(key, KINDS[k], a, b, text[a:b]) for a, k, b in sorted(row[0] + row[1])]

    schema = pa.schema([(id_column, pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("secret", pa.string())])
    return scanned(documents, out, schema, words, least, id_column, text_column)


def redacted(documents: DataFrame, words: int = 50_000, least: float = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_redacted, text)``: each text with every stretch that spans cover replaced by the kind of its first span in brackets."""

    def out(key: int | None, text: str, row: Row) -> list[tuple]:
        parts, at, n = [], 0, 0
        for a, k, b in sorted(row[0] + row[1]):
            if a >= at:
                parts += [text[at:a], f"[{KINDS[k]}]"]
                n += 1
            at = max(at, b)
        return [(key, n, "".join(parts) + text[at:])]

    schema = pa.schema([(id_column, pa.int64()), ("n_redacted", pa.int64()), ("text", pa.string())])
    return scanned(documents, out, schema, words, least, id_column, text_column)


def digest(documents: DataFrame, words: int = 50_000, least: float = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and a hash of each text's pattern spans, all its spans, and how many values in a credential's place are cheap."""

    def out(key: int | None, text: str, row: Row) -> list[tuple]:
        base, added, costs = row
        n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        return [(key, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added), sum(c < least for c in costs), max(costs, default=None))]

    schema = pa.schema(
        [(id_column, pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
        + [("n_guess", pa.int64()), ("n_cheap", pa.int64()), ("greatest_cost", pa.float64())]
    )
    return scanned(documents, out, schema, words, least, id_column, text_column)
