"""Joins of positions with ranges, and of names with prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(points: DataFrame, ranges: DataFrame, owner: list[str], at: str, low: str, high: str, width: int = 64) -> DataFrame:
    """Rows of ``points`` with each row of ``ranges`` of the same owner whose bounds, both included, hold the point.

    Ranges of any length: one is dealt to the bands of ``width`` that it touches, a point to its own band, and the
    band joins the equality of the owner. So no owner's points meet all of its ranges.
    """
    band = lambda c: F.floor(c / width)
    dealt = ranges.filter(F.col(low) <= F.col(high)).withColumn("band_", F.explode(F.sequence(band(F.col(low)), band(F.col(high)))))
    met = points.withColumn("band_", band(F.col(at))).join(dealt, [*owner, "band_"])
    return met.filter(F.col(at).between(F.col(low), F.col(high))).drop("band_")


def owner_by_name(names: DataFrame, exact: DataFrame, prefixes: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with the ``owner`` of the exact entry, else that of the longest prefix; null if there is neither.

    ``exact(entry, owner)``, ``prefixes(entry, owner)``. The lengths that prefixes have are few: a name is cut to each
    and meets the prefixes by equality.
    """
    key = F.upper(F.col(name))
    sizes = [r.n for r in prefixes.select(F.length("entry").alias("n")).distinct().orderBy(F.desc("n")).collect()]  # as many as there are lengths
    tried = F.array(F.struct(F.lit(True).alias("whole"), key.alias("entry")), *(F.struct(F.lit(False).alias("whole"), F.substring(key, 1, n).alias("entry")) for n in sizes))
    known = exact.select(F.lit(True).alias("whole"), F.upper("entry").alias("entry"), "owner").union(prefixes.select(F.lit(False), F.upper("entry"), "owner"))
    cut = names.select(name).distinct().withColumn("x_", F.explode(tried)).select(name, "x_.*")
    best = cut.join(known, ["whole", "entry"]).groupBy(name).agg(F.max_by("owner", F.struct("whole", F.length("entry"))).alias("owner"))
    return names.join(best, name, "left")


def split_by_position(rows: DataFrame, owner: list[str], items: Column, item: str = "item") -> DataFrame:
    """``(owner, pos, item)`` of an array column, places from 1."""
    return rows.select(*owner, F.posexplode(items).alias("pos", item)).withColumn("pos", F.col("pos") + 1)
