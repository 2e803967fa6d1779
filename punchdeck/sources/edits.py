"""Places in a source as byte offsets of its code page, and edits applied to its bytes.

Lines and columns count from 1, columns in characters. Texts stay with their rows: offsets of lines are a window over a
source's lines, and an edit names its source, so edits of all sources are placed by joins and applied side by side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType


@pandas_udf(LongType())
def _encoded_length(text: pd.Series, code_page: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else len(t.encode(c, "replace")) for t, c in zip(text, code_page, strict=True)], dtype="Int64")


@pandas_udf(IntegerType())
def _characters(text: pd.Series, code_page: pd.Series, at: pd.Series) -> pd.Series:
    """How many characters end within the first ``at`` bytes."""

    def fit(t: str, code: str, n: int) -> int:
        got = 0
        for i, c in enumerate(t):
            got += len(c.encode(code, "replace"))
            if got > n:
                return i
        return len(t)

    return pd.Series([None if t is None else fit(t, c, int(n)) for t, c, n in zip(text, code_page, at, strict=True)], dtype="Int32")


def byte_length(text: Column, code_page: Column) -> Column:
    """Bytes of a text; those of UTF-8 are counted without leaving the JVM."""
    return F.when(F.lower(code_page).isin("utf-8", "utf8"), F.octet_length(text).cast("long")).otherwise(_encoded_length(text, code_page))


def lines(sources: DataFrame) -> DataFrame:
    """``sources(source, text, code_page)`` as ``(source, code_page, line, text, start)``, ``start`` the byte offset of the line from 0; a
    break is one character of the code page, with a carriage return two."""
    rows = sources.select("source", "code_page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "text"))
    rows = rows.withColumn("size", byte_length(F.col("text"), F.col("code_page")) + byte_length(F.lit("\n"), F.col("code_page")))
    before = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("source", "code_page", (F.col("at") + 1).cast("int").alias("line"), "text", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))


def byte_offsets(places: DataFrame, lines: DataFrame) -> DataFrame:
    """``places(source, line, col, ...)`` with ``offset``, null where the source has no such line; a column past a line's end is its end."""
    met = places.join(lines.select("source", "line", F.col("text").alias("text_"), F.col("code_page").alias("page_"), F.col("start").alias("start_")), ["source", "line"], "left")
    ahead = F.substring(F.regexp_replace("text_", "\r$", ""), F.lit(1), F.greatest(F.col("col") - 1, F.lit(0)))
    return met.withColumn("offset", F.col("start_") + byte_length(ahead, F.col("page_"))).select(*places.columns, "offset")


def columns_of_bytes(places: DataFrame, lines: DataFrame) -> DataFrame:
    """``places(source, line, byte_col, ...)`` with ``col``, the column of the character that holds that byte column."""
    met = places.join(lines.select("source", "line", F.col("text").alias("text_"), F.col("code_page").alias("page_")), ["source", "line"], "left")
    return met.withColumn("col", _characters("text_", "page_", F.col("byte_col") - 1) + 1).select(*places.columns, "col")


@pandas_udf(StructType().add("content", BinaryType()).add("refused", StringType()))
def _spliced(content: pd.Series, code_page: pd.Series, edits: pd.Series) -> pd.DataFrame:
    out = []
    for raw, code, given in zip(content, code_page, edits, strict=True):
        raw = b"" if raw is None else bytes(raw)
        breaks, line_end = "\n".encode(code), "\r\n".encode(code)
        apart = line_end if line_end in raw else breaks
        parts, at, refused = [], 0, None
        for e in given:
            # an offset that is not there makes the others come as floats
            start, stop = (-1 if pd.isna(e[k]) else int(e[k]) for k in ("start", "stop"))
            if not 0 <= start <= stop <= len(raw):
                refused = "place"
            elif start < at:
                refused = "overlap"
            if refused:
                break
            try:
                new = apart.join((e["replacement"] or "").replace("\r\n", "\n").encode(code).split(breaks))
            except UnicodeEncodeError:
                refused = "code page"
                break
            if start == len(raw) and raw and not raw.endswith(breaks):
                new = apart + new
            parts += [raw[at:start], new]
            at = stop
        out.append((None, refused) if refused else (b"".join([*parts, raw[at:]]), None))
    return pd.DataFrame(out, columns=["content", "refused"])


def spliced(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """``(source, content, refused)``: the bytes of ``sources(source, content, code_page)`` with ``edits(source, start, stop, replacement)`` applied.

    Edits are ordered by where they start and must not overlap; two at one place go in the order of their ends, then
    texts. A source of which an edit overlaps, lies outside or can't be written in the code page is refused as a whole.
    New breaks are those of the source, and what is put behind a last line without one begins with one. A source
    without edits keeps its bytes.
    """
    of = edits.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "replacement"))).alias("edits"))
    rows = sources.join(of, "source", "left")
    done = rows.filter("edits is not null").withColumn("s", _spliced("content", "code_page", "edits")).select("source", "s.content", "s.refused")
    return done.union(rows.filter("edits is null").select("source", F.coalesce("content", F.lit(b"")), F.lit(None).cast("string")))


def placed(edits: DataFrame, lines: DataFrame) -> DataFrame:
    """``edits(source, line, col, end_line, end_col, replacement)`` as byte ranges; the end is the first character not replaced."""
    rows = edits.withColumn("edit_", F.struct("line", "col", "end_line", "end_col", "replacement"))
    start = byte_offsets(rows, lines).withColumnRenamed("offset", "start").select("source", "edit_", "start", F.col("end_line").alias("line"), F.col("end_col").alias("col"))
    return byte_offsets(start, lines).select("source", "start", F.col("offset").alias("stop"), F.col("edit_.replacement").alias("replacement"))
