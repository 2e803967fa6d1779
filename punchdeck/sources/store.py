"""A store of facts by content: a run takes apart only the sources whose key changed, and rewrites only their partitions.

``<root>/<table>`` holds rows of all sources with ``source, key, id`` and ``part``, a hash of the source, by which tables are
partitioned; their number is fixed when the store is made, so files stay large however many sources there are. ``<root>/keys``
holds for each source its key, its number, and of each table how many rows it has and a checksum of them.

An update writes the tables first, by dynamic overwrite of the touched partitions, and the keys last. Rows count only with a
source and key that ``keys`` has; so a run that was broken off, a file that can't be read or rows that are gone leave
the source without valid facts, and the next update takes it apart again. Ids are strided: a source has the numbers from
its own times ``STRIDE``, and keeps its number as long as it is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punchdeck.operators.graph import cut, written

STRIDE = 1_000_000
KEYS = "source string, key string, number long, rows map<string,long>, sums map<string,long>, part int"


def content_key(content: Column, *environment: Column | str) -> Column:
    """A key of a source's bytes and of what else its facts depend on (code page, versions of what reads it)."""
    return F.sha2(F.concat(*(F.concat(F.sha2(F.coalesce(c.cast("binary") if isinstance(c, Column) else F.lit(c).cast("binary"), F.lit(b"")), 256), F.lit(";")) for c in (content, *environment))), 256)


def _read(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    try:
        # files that can't be read are passed over; what they held is missed by its sums
        return spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(f"{root}/{table}")
    except AnalysisException:
        return None


def keys(spark: SparkSession, root: str) -> DataFrame:
    found = _read(spark, root, "keys")
    return spark.createDataFrame([], KEYS) if found is None else found.filter("source is not null")


def read(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """Rows of a table that count, without ``part``; None if the store has no such table."""
    rows = _read(spark, root, table)
    return None if rows is None else rows.join(keys(spark, root).select("source", "key"), ["source", "key"], "left_semi").drop("part")


def _sums(rows: DataFrame) -> DataFrame:
    """``(source, key, n, sum)`` of a table's rows; the sum doesn't depend on their order."""
    plain = [c for c in rows.columns if c not in ("source", "key", "part", "id")]
    row = F.to_json(F.struct(*sorted(plain)))
    return rows.groupBy("source", "key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(row, "id")).alias("sum"))


def valid(spark: SparkSession, root: str) -> DataFrame:
    """The rows of ``keys`` whose tables hold what they should."""
    known = keys(spark, root)
    tables = sorted({t for (t,) in known.select(F.explode(F.map_keys("rows"))).distinct().collect()})  # the names of the tables
    for t in tables:
        rows = _read(spark, root, t)
        there = _sums(rows) if rows is not None else spark.createDataFrame([], "source string, key string, n long, sum long")
        met = known.join(there, ["source", "key"], "left")
        known = met.filter((F.coalesce("n", F.lit(0)) == F.coalesce(F.col("rows")[t], F.lit(0))) & (F.coalesce("sum", F.lit(0)) == F.coalesce(F.col("sums")[t], F.lit(0)))).drop("n", "sum")
    return known


def update(root: str, sources: DataFrame, facts: Callable[[DataFrame], dict[str, DataFrame]], parts: int = 64) -> DataFrame:
    """Bring the store to ``sources(source, key, ...)``; returns ``(source, change)`` of those ``added``, ``changed``, ``damaged`` and ``removed``.

    ``facts`` gives for some of the sources the rows of each table, with ``source`` and the order ``seq`` of a source's rows;
    it is called once, for the sources that are not in the store as they are. Of rows with one source the smallest key counts.
    """
    spark = sources.sparkSession
    part = F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int")
    now = sources.dropDuplicates(["source", "key"]).withColumn("n_", F.row_number().over(Window.partitionBy("source").orderBy("key"))).filter("n_ = 1").drop("n_")
    good = cut(valid(spark, root))
    old = keys(spark, root).select("source", F.col("key").alias("old_key"), F.col("number").alias("old_number"))
    state = now.select("source", "key").join(good.select("source", "key", F.lit(True).alias("good")), ["source", "key"], "left").join(old, "source", "full")
    change = (
        F.when(F.col("key").isNull(), "removed").when(F.col("old_key").isNull(), "added").when(F.col("key") != F.col("old_key"), "changed").when(F.col("good").isNull(), "damaged")
    )
    state = cut(state.withColumns({"change": change, "part": part}))
    told = state.filter("change is not null")
    if told.isEmpty():
        return told.select("source", "change")
    # a number that is free, of those that the source's partition gives out
    top = state.groupBy("part").agg(F.max("old_number").alias("top"))
    fresh = state.filter("key is not null and change is not null").join(top, "part")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("old_number").isNotNull(), "source"))
    number = F.coalesce("old_number", F.coalesce(F.col("top"), F.col("part") - F.lit(parts)) + nth * parts)
    fresh = cut(fresh.select("source", "key", number.cast("long").alias("number"), "part"))
    touched = [r.part for r in told.select("part").distinct().collect()]  # at most ``parts``
    stay = cut(good.join(state.filter("change is null").select("source"), "source", "left_semi"))
    sums = None
    made = facts(now.join(fresh.select("source"), "source", "left_semi"))
    for name, rows in made.items():
        own = rows.join(fresh, "source")
        row_id = F.col("number") * STRIDE + F.row_number().over(Window.partitionBy("source").orderBy("seq")) - 1
        own = written(own.withColumn("id", row_id).drop("number"))
        n = _sums(own).withColumn("table", F.lit(name))
        sums = n if sums is None else sums.union(n)
        before = _read(spark, root, name)
        if before is not None:
            kept = before.filter(F.col("part").isin(touched)).join(stay.select("source", "key"), ["source", "key"], "left_semi")
            own = own.unionByName(written(kept), allowMissingColumns=True)
        own.repartition("part").write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root}/{name}")
    told_sums = sums.groupBy("source", "key").agg(F.map_from_entries(F.collect_list(F.struct("table", "n"))).alias("rows"), F.map_from_entries(F.collect_list(F.struct("table", "sum"))).alias("sums"))
    none = F.create_map(*(x for t in made for x in (F.lit(t), F.lit(0).cast("long")))) if made else F.create_map().cast("map<string,long>")
    filled = lambda c: F.map_concat(F.map_filter(none, lambda k, _: ~F.coalesce(F.map_contains_key(c, k), F.lit(False))), F.coalesce(F.col(c), F.create_map().cast("map<string,long>")))
    new = fresh.join(told_sums, ["source", "key"], "left").select("source", "key", "number", filled("rows").alias("rows"), filled("sums").alias("sums"), "part")
    keyed = new.unionByName(stay.filter(F.col("part").isin(touched)).select(*new.columns))
    # a partition left without sources is written as one that has none
    empty = spark.createDataFrame([(None, None, None, None, None, p) for p in touched], KEYS)
    cut(keyed.unionByName(empty)).repartition("part").write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root}/keys")
    return told.select("source", "change")
