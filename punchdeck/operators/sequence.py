"""Operators that depend on the order of rows within an owner, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.operators.graph import cut


def before(owner: str, *order: str):
    return Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def numbered(edges: DataFrame, owner: str, line: str, arrival: str) -> DataFrame:
    """``seq``: number within the owner by line, lines that are null last."""
    return edges.withColumn("seq", F.row_number().over(Window.partitionBy(owner).orderBy(F.col(line).asc_nulls_last(), arrival)))


def later_duplicates(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The second and later rows of each key, with ``nth``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth > 1")


def last_before(rows: DataFrame, owner: str, value: Column, *order: str, name: str = "last_value") -> DataFrame:
    """The last non-null ``value`` of earlier rows: a clause that is in effect until the next one."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(before(owner, *order)))


def unchecked(rows: DataFrame, owner: str, is_start: Column, is_check: Column, *order: str) -> DataFrame:
    """Start rows that no check follows before the owner's next start."""
    w = Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = rows.withColumns({"is_start_": is_start, "is_check_": is_check}).withColumn("part_", F.sum(F.col("is_start_").cast("int")).over(w))
    some = Window.partitionBy(owner, "part_")
    part = part.withColumn("checked_", F.max("is_check_").over(some))
    return part.filter("is_start_ and not checked_").drop("is_start_", "is_check_", "part_", "checked_")


def last_of(rows: DataFrame, owner: str, order: str, at_least: int) -> DataFrame:
    w = Window.partitionBy(owner)
    ranked = rows.withColumns({"back_": F.row_number().over(w.orderBy(F.desc(order))), "size_": F.count("*").over(w)})
    return ranked.filter((F.col("back_") == 1) & (F.col("size_") >= at_least)).drop("back_", "size_")


def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``name``: the place of each row in the order of all, from 1. Rows are dealt out by ranges and numbered within them, so no task holds all;
    what lies before a range is a sum over as many rows as there are ranges."""
    laid = cut(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    before_ = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = laid.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", before_.alias("before_"))
    numbered_ = laid.withColumn("nth_", F.row_number().over(Window.partitionBy("part_").orderBy(*order)))
    return numbered_.join(sizes, "part_").withColumn(name, F.col("before_") + F.col("nth_")).drop("part_", "before_", "nth_")
