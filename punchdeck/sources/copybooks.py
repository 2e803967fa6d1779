"""Copybooks of search folders: which file a name means, as a join on what a file may be called by.

The files of a name are ranked before they meet the uses, so that a use meets one row, however often its name is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What may stand behind a name, in the order it is tried.
EXTENSIONS = ("", ".cpy", ".CPY", ".copy", ".COPY")


def called(files: DataFrame, folders: DataFrame) -> DataFrame:
    """``(name, path)``: the file that each name means, of ``files(path)`` in the search ``folders(folder, rank)``: the folder with the smallest
    rank first, in it the name as written before those with an extension. Letters count as they are written; folders below aren't searched."""
    slashed = F.regexp_replace("path", r"\\", "/")
    rows = files.filter("path is not null").select("path", F.regexp_extract(slashed, r"^(?:(.*)/)?[^/]*$", 1).alias("folder"), F.regexp_extract(slashed, r"([^/]*)$", 1).alias("file"))
    searched = folders.groupBy(F.regexp_replace(F.regexp_replace("folder", r"\\", "/"), r"(?<=.)/+$", "").alias("folder")).agg(F.min("rank").alias("rank"))
    known = F.array(*(F.when(F.col("file").endswith(x), F.struct(F.lit(k).alias("nth"), F.expr(f"left(file, length(file) - {len(x)})").alias("name"))) for k, x in enumerate(EXTENSIONS)))
    rows = rows.join(searched, "folder").select("path", "rank", F.explode(F.array_compact(known)).alias("x")).filter("x.name <> ''")
    return rows.groupBy("x.name").agg(F.min_by("path", F.struct("rank", "x.nth", "path")).alias("path"))


def resolved(uses: DataFrame, called: DataFrame) -> DataFrame:
    """``uses`` with ``path`` of the copybook that their ``name`` means, null if there is none."""
    return uses.join(called, "name", "left")
