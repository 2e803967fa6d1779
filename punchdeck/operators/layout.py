"""Record layouts from data items: ``items(program, idx, level, name, bytes, occurs, redefines)`` in source order.

``bytes`` is null for groups; ``occurs`` is null or the number of times; ``redefines`` names an earlier item of the
same group. Levels 66, 77 and 88 have no place in a record's tree but 77, which is one of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.operators.graph import cut


def with_ancestors(items: DataFrame) -> DataFrame:
    """Adds ``ancestors``, the ``idx`` of the groups an item lies in, the nearest last.

    The last item of each level is carried along the source; one of a smaller level closes those before it.
    """
    rows = items.filter(~F.col("level").isin(66, 88)).withColumn("depth", F.when(F.col("level") == 77, 1).otherwise(F.col("level")))
    w = Window.partitionBy("program").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.array(*(F.struct(F.max(F.when(F.col("depth") == k, F.col("idx"))).over(w).alias("idx"), F.lit(k).alias("depth")) for k in range(1, 50)))
    rows = rows.withColumn("last", F.filter(last, lambda x: x["idx"].isNotNull() & (x["depth"] < F.col("depth"))))
    still = F.filter("last", lambda x: ~F.exists("last", lambda y: (y["depth"] < x["depth"]) & (y["idx"] > x["idx"])))
    return rows.withColumn("ancestors", F.transform(still, lambda x: x["idx"])).drop("last", "depth")


def with_parents(items: DataFrame) -> DataFrame:
    """Adds ``parent``, the ``idx`` of the group an item belongs to: the nearest earlier item of a smaller level.

    The last item of each level is carried along the source; the nearest of those that no smaller level has closed.
    """
    rows = items.filter(~F.col("level").isin(66, 88)).withColumn("depth", F.when(F.col("level") == 77, 1).otherwise(F.col("level")))
    w = Window.partitionBy("program").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    levels = [r.depth for r in rows.select("depth").distinct().orderBy("depth").collect()]  # at most 49
    last = F.array(*(F.struct(F.max(F.when(F.col("depth") == k, F.col("idx"))).over(w).alias("idx"), F.lit(k).alias("depth")) for k in levels))
    open_ = F.filter("last", lambda x: x["idx"].isNotNull() & (x["depth"] < F.col("depth")))
    # a later item of a smaller or equal level closes the group: the greatest idx among smaller levels is the parent
    return rows.withColumn("last", last).withColumn("parent", F.array_max(F.transform(open_, lambda x: x["idx"]))).withColumn("parent", F.when(F.col("depth") > 1, F.col("parent"))).drop("last")


def lengths(items: DataFrame) -> DataFrame:
    """Adds ``own`` (bytes of one occurrence) and ``span`` (of all of them): a group is the sum of its items that redefine
    nothing. Groups are summed from the deepest level up, a round for each depth of nesting."""
    rows = cut(with_parents(items).withColumn("own", F.col("bytes").cast("long")))
    times = F.coalesce("occurs", F.lit(1))
    while not rows.filter("own is null").isEmpty():
        kids = rows.filter("parent is not null").groupBy("program", F.col("parent").alias("idx")).agg(
            F.sum(F.when(F.col("redefines").isNull(), F.col("own") * times).otherwise(0)).alias("total"), F.count_if(F.col("own").isNull()).alias("open")
        )
        known = rows.join(kids, ["program", "idx"], "left")
        # an item without bytes and without items of its own takes none
        rows = cut(known.withColumn("own", F.coalesce("own", F.when(F.coalesce("open", F.lit(0)) == 0, F.coalesce("total", F.lit(0))))).drop("total", "open"))
    return rows.withColumn("span", F.col("own") * times)


def offsets(items: DataFrame) -> DataFrame:
    """``(program, idx, name, offset, own, span)``, offsets from the start of the record; a REDEFINES takes its target's."""
    rows = lengths(items)
    w = Window.partitionBy("program", "parent").orderBy("idx")
    before = F.coalesce(F.sum(F.when(F.col("redefines").isNull(), F.col("span")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inside", F.when(F.col("parent").isNull(), F.lit(0)).otherwise(before))
    target = rows.select("program", F.coalesce("parent", F.lit(-1)).alias("up"), F.upper("name").alias("target"), F.col("inside").alias("there"))
    rows = rows.withColumn("up", F.coalesce("parent", F.lit(-1))).withColumn("target", F.upper("redefines")).join(target, ["program", "up", "target"], "left")
    rows = cut(rows.withColumn("inside", F.coalesce("there", "inside")).select("program", "idx", "name", "parent", "inside", "own", "span"))
    front = rows.filter("parent is null").withColumn("offset", F.col("inside"))
    out = front
    while not front.isEmpty():
        up = front.select("program", F.col("idx").alias("parent"), F.col("offset").alias("base"))
        front = cut(rows.join(up, ["program", "parent"]).withColumn("offset", F.col("base") + F.col("inside")).select(*front.columns))
        out = out.union(front)
    return out.select("program", "idx", "name", "offset", "own", "span")


def too_short_commareas(passed: DataFrame, received: DataFrame) -> DataFrame:
    """``passed(program, callee, size, line)`` of which the callee's ``DFHCOMMAREA`` (``received(program, size)``) is longer."""
    there = received.select(F.col("program").alias("callee"), F.col("size").alias("received"))
    return passed.join(there, "callee").filter("received > size")
