"""Assembler macro sources (BMS maps, DBD and PSB generation) to one row for each macro, and facts from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.sources.jcl import operands

SCHEMA = "file string, line int, seq int, label string, op string, parameters map<string,string>"


def macros(text: str) -> list[dict]:
    """Label, operation and keyword operands; column 72 or a trailing comma continues, ``*`` in column 1 is a comment."""
    out, rows, at = [], text.split("\n"), 0
    while at < len(rows):
        raw, start = rows[at], at
        at += 1
        if not raw.strip() or raw.startswith("*"):
            continue
        found = re.match(r"^(\S*)\s+(\S+)(?:\s+(.*))?$", raw[:71].rstrip())
        if not found:
            continue
        parts = operands(found[3] or "")
        while parts[-1] == "" and len(parts) > 1 and at < len(rows):
            parts = parts[:-1] + operands(rows[at][:71].strip())
            at += 1
        keyed = dict(p.split("=", 1) for p in parts if "=" in p)
        out.append({"line": start + 1, "label": found[1].upper(), "op": found[2].upper(), "parameters": keyed})
    return out


def parse(sources: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"file": path, "seq": k, **m} for path, text in zip(frame["path"], frame["text"], strict=True) for k, m in enumerate(macros(text or ""))]
            yield pd.DataFrame(rows, columns=["file", "line", "seq", "label", "op", "parameters"])

    return sources.select("path", "text").mapInPandas(run, SCHEMA)


def bms_fields(rows: DataFrame) -> DataFrame:
    """``(file, line, mapset, map, field, row, col, length, attributes)``."""
    w = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    held = lambda op: F.last(F.when(F.col("op") == op, F.col("label")), ignorenulls=True).over(w)
    at = F.split(F.regexp_replace(F.col("parameters")["POS"], "[()]", ""), ",")
    rows = rows.withColumns({"mapset": held("DFHMSD"), "map": held("DFHMDI")}).filter("op = 'DFHMDF'")
    return rows.select("file", "line", "mapset", "map", F.nullif("label", F.lit("")).alias("field"), F.get(at, 0).try_cast("int").alias("row"), F.get(at, 1).try_cast("int").alias("col"), F.col("parameters")["LENGTH"].try_cast("int").alias("length"), F.col("parameters")["ATTRB"].alias("attributes"))


def ims_segments(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("parameters")
    rows = rows.withColumn("dbd", F.last(F.when(F.col("op") == "DBD", p["NAME"]), ignorenulls=True).over(w))
    return rows.filter("op = 'SEGM'").select("file", "line", "dbd", p["NAME"].alias("segment"), parent(p["PARENT"]).alias("parent"), F.get(F.split(F.regexp_replace(p["BYTES"], "[()]", ""), ","), 0).try_cast("int").alias("bytes"))


def ims_sensegs(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("parameters")
    rows = rows.withColumns({"dbd": F.last(F.when(F.col("op") == "PCB", F.coalesce(p["DBDNAME"], p["NAME"])), ignorenulls=True).over(w), "pcb": F.sum((F.col("op") == "PCB").cast("int")).over(w)})
    return rows.filter("op = 'SENSEG'").select("file", "line", "pcb", "dbd", p["NAME"].alias("segment"), parent(p["PARENT"]).alias("parent"), p["PROCOPT"].alias("procopt"))


def parent(text):
    """A root has the parent 0 or none."""
    first = F.get(F.split(F.regexp_replace(text, "[()]", ""), ","), 0)
    return F.when(first != "0", first)
