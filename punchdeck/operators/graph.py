"""Graph operators over ``edges(from_id, to_id)``: closure, bounded search, roots, traces.

Cyclic closures are loops of joins against what is already reached; each round's state is cut with a reliable
checkpoint, so the plan stays short and an executor that is lost costs a round's partitions only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, ``spark.checkpoint.dir``; one of our own only on one machine without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="punchdeck-")
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder. A checkpoint runs its plan twice, once to count and once to write, unless the rows are held."""
    shared_folder(df.sparkSession)
    held = df.select("*").persist(StorageLevel.DISK_ONLY)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def written(df: DataFrame) -> DataFrame:
    """``df`` cut with a Parquet table in the shared folder: smaller than a checkpoint for rows of text."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` by ``key`` in as many partitions as the session shuffles into. Asked for by number, they are not drawn together because they hold
    few bytes: what a function does with the groups of a key costs more than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# The Arrow type of each type that group functions return.
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
#: Rows that a task gathers before it sends them on.
SENT = 8_192


def _cells(column: pa.Array) -> list:
    kind = column.type
    if pa.types.is_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_list(kind):
        cells, out, start = _cells(column.flatten()), [], 0
        for size in _cells(column.value_lengths()):
            out.append(None if size is None else cells[start : start + size])
            start += size or 0
        return out
    if not pa.types.is_integer(kind):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return [x if there else None for x, there in zip(column.fill_null(0).to_numpy(zero_copy_only=False).tolist(), column.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]


def each_group(df: DataFrame, key: str, run: Callable[[dict[str, list]], list[tuple]], columns: str, *order: str) -> DataFrame:
    """``(key, columns)``: what ``run`` returns for the rows of each key, which it gets as a list for each column, sorted by ``order``.

    Rows are dealt out and sorted by key, a task cuts its batches where the key changes: groups are small and many, and a
    frame of its own for each would cost more than what is done with it.
    """
    names, rest = df.columns, [c.rsplit(" ", 1) for c in columns.split(", ")]

    def sent(found: list[tuple], keyed: pa.DataType) -> pa.RecordBatch:
        types = [keyed, *(ARROW[t] for _, t in rest)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[key, *(n for n, _ in rest)])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict[str, list], pa.DataType]]:
        held: dict[str, list] = {}
        for batch in batches:
            cells, keyed = {n: _cells(batch.column(n)) for n in names}, batch.schema.field(key).type
            keys, start = cells[key], 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                part = {n: c[start:end] for n, c in cells.items()}
                if held and held[key][0] == keys[start]:
                    for n, c in part.items():
                        held[n] += c
                else:
                    if held:
                        yield held[key][0], held, keyed
                    held = part
                start = end
        if held:
            yield held[key][0], held, keyed

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, keyed = [], None
        for value, rows, keyed in groups(batches):  # noqa: B007
            found += [(value, *r) for r in run(rows)]
            if len(found) >= SENT:
                yield sent(found, keyed)
                found = []
        if found:
            yield sent(found, keyed)

    kind = df.schema[key].dataType.simpleString()
    return dealt(df, key).sortWithinPartitions(key, *order).mapInArrow(each, f"{key} {kind}, {columns}")


#: Rows that are turned into lists at once.
TAKEN = 512


def each_row(df: DataFrame, key: str, run: Callable[..., list[tuple]], columns: str) -> DataFrame:
    """``(key, columns)``: what ``run`` returns for each row, of whose other columns it gets the values in their order, arrays as lists.

    For what is whole in one row: nothing is dealt out, sorted or written in between.
    """
    names, rest = [c for c in df.columns if c != key], [c.rsplit(" ", 1) for c in columns.split(", ")]

    def values(column: pa.Array) -> list:
        return [x or [] for x in _cells(column)] if pa.types.is_list(column.type) else _cells(column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TAKEN):
                part = batch.slice(start, TAKEN)
                found, at = [], []
                for i, cells in enumerate(zip(*(values(part.column(n)) for n in names), strict=True)):
                    rows = run(*cells)
                    found += rows
                    at += [i] * len(rows)
                if found:
                    made = (pa.array(c, ARROW[t]) for c, (_, t) in zip(zip(*found, strict=True), rest, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at, pa.int32())), *made], names=[key, *(n for n, _ in rest)])

    return df.mapInArrow(each, f"{key} {df.schema[key].dataType.simpleString()}, {columns}")


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None, with_start: bool = False) -> DataFrame:
    """``(id, hops)`` of the nodes reached from ``start(id)``. Without ``with_start`` a start node counts only if an
    edge leads back to it. ``depth`` bounds the hops. The edges are written once, each hop writes its own nodes only."""
    edges = cut(edges.select("from_id", "to_id").distinct())
    hop, front = 0, cut(start.select("id").distinct())
    seen = [front.withColumn("hops", F.lit(0))] if with_start else []
    while (depth is None or hop < depth) and not front.isEmpty():
        hop += 1
        step = edges.join(front, edges["from_id"] == front["id"], "left_semi").select(F.col("to_id").alias("id")).distinct()
        if seen:
            step = step.join(reduce(DataFrame.union, seen), "id", "left_anti")
        front = cut(step)
        seen.append(front.withColumn("hops", F.lit(hop)))
    return reduce(DataFrame.union, seen) if seen else front.withColumn("hops", F.lit(0)).limit(0)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("from_id", "to_id").union(edges.select("to_id", "from_id")).distinct()


def roots(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Where a view of the graph starts: nodes of ``kinds`` (jobs and transactions) with the isolated nodes; without such
    nodes those that nothing leads to; all nodes if there is none of these either."""
    chosen = nodes.filter(F.col("kind").isin(*kinds)).select("id") if kinds else nodes.select("id").limit(0)
    if not chosen.isEmpty():
        return chosen.union(isolated(nodes, edges)).distinct()
    free = nodes.select("id").join(edges.select(F.col("to_id").alias("id")), "id", "left_anti")
    return nodes.select("id") if free.isEmpty() else free


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id"))
    return nodes.select("id").join(used, "id", "left_anti")


def traces(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``(path array, id, depth)`` of all walks that don't meet a node twice; a row budget belongs to the caller."""
    front = start.select(F.array("id").alias("path"), "id", F.lit(0).alias("depth"))
    out = front
    for k in range(1, depth + 1):
        front = front.join(edges, F.col("id") == F.col("from_id")).filter(~F.array_contains("path", F.col("to_id")))
        front = front.select(F.concat("path", F.array("to_id")).alias("path"), F.col("to_id").alias("id"), F.lit(k).alias("depth"))
        out = out.union(front)
    return out


def execution_tree(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``(path, id, depth, via, repeats)``: execution from jobs down to paragraphs, in the order of ``seq`` (0 last).

    ``edges(from_id, to_id, kind, seq)``. A GOTO is a row of its own that isn't followed, as control doesn't come back
    from it; a node that stands on its own path is marked and isn't followed either. ``path`` holds the places among
    the edges of each node above, so ordering by it flattens the tree.
    """
    order = F.struct(F.when(F.col("seq") == 0, 1).otherwise(0), "seq", "to_id")
    placed = edges.withColumn("place", F.row_number().over(Window.partitionBy("from_id").orderBy(order)))
    placed = cut(placed.select("from_id", "to_id", "kind", "place"))
    rank = F.row_number().over(Window.orderBy("id"))  # over the roots of a view
    front = start.select(F.array(rank).alias("path"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(False).alias("repeats"), F.array("id").alias("above"))
    out = [front]
    for k in range(1, depth + 1):
        open_ = out[-1].filter("not repeats and coalesce(via, '') <> 'GOTO'")
        met = open_.drop("depth", "via", "repeats").join(placed, F.col("id") == F.col("from_id"))
        out.append(cut(met.select(F.concat("path", F.array("place")).alias("path"), F.col("to_id").alias("id"), F.lit(k).alias("depth"), F.col("kind").alias("via"), F.array_contains("above", F.col("to_id")).alias("repeats"), F.concat("above", F.array("to_id")).alias("above"))))
        if out[-1].isEmpty():
            break
    return reduce(DataFrame.union, out).drop("above")


def combined_access(held: Column) -> Column:
    """Accesses in order of arrival: READ and WRITE make UPDATE, UPDATE absorbs them; any other stays as it came first."""
    pair = lambda a, b: (a == "UPDATE") & b.isin("READ", "WRITE") | (b == "UPDATE") & a.isin("READ", "WRITE") | (a == "READ") & (b == "WRITE") | (a == "WRITE") & (b == "READ")
    return F.aggregate(held, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull(), b).when(pair(a, b), "UPDATE").otherwise(a))


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge of each identity ``(from_id, to_id, kind, resolution)``: the line that came first stays and accesses
    combine. Lists such as plans, binds and launchers (array columns) gather their distinct values in order of arrival;
    of all other columns the first value stays. A group is the mentions of one edge."""
    known = {"from_id", "to_id", "kind", "resolution", "line", "arrival", "access"}
    more = [f for f in edges.schema.fields if f.name not in known]
    held = F.array_sort(F.collect_list(F.struct("arrival", "line", "access", *(f.name for f in more))))
    rows = edges.groupBy("from_id", "to_id", "kind", "resolution").agg(held.alias("held"))
    kept = lambda c: F.filter(F.transform("held", lambda x: x[c]), lambda x: x.isNotNull())
    first = lambda c: F.get(kept(c), F.lit(0))
    made = [F.array_distinct(F.flatten(kept(f.name))).alias(f.name) if isinstance(f.dataType, ArrayType) else first(f.name).alias(f.name) for f in more]
    return rows.select("from_id", "to_id", "kind", "resolution", F.get("held", F.lit(0))["line"].alias("line"), F.get("held", F.lit(0))["arrival"].alias("arrival"), combined_access(kept("access")).alias("access"), *made)


def first_writer(nodes: DataFrame) -> DataFrame:
    """Of the rows of a node the one with the smallest ``priority``."""
    columns = [c for c in nodes.columns if c not in ("id", "priority")]
    return nodes.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("priority", *columns)).alias("n")).select("id", "n.*")


def detail(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    """``(direction, kind, id, label)`` of the edges into and out of a node."""
    out = edges.filter(F.col("from_id") == id_).select(F.lit("out").alias("direction"), "kind", F.col("to_id").alias("id"))
    into = edges.filter(F.col("to_id") == id_).select(F.lit("in"), "kind", "from_id")
    return out.union(into).join(nodes.select("id", "label"), "id", "left").select("direction", "kind", "id", "label")


def visible(nodes: DataFrame, reached: DataFrame, kinds: list[str]) -> DataFrame:
    """Nodes that a view reaches and whose kind is switched on."""
    return nodes.filter(F.col("kind").isin(*kinds)).join(reached.select("id").distinct(), "id", "left_semi")


def found_by_label(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose label holds the text, without regard to case; an empty text finds none."""
    text = text.strip().lower()
    return nodes.filter(F.contains(F.lower("label"), F.lit(text)) if text else F.lit(False))


def kind_totals(nodes: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(kind, n)`` for each of ``kinds(kind)``, those without a node too."""
    return kinds.join(nodes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").fillna(0, ["n"])


def retyped(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asset rows as a view shows them: a JCL with a step is a JOB, an Easytrieve source with an edge a PROGRAM; edges
    from a JCL straight to a program go, as its steps have them."""
    steps = edges.filter("kind = 'STEP'").select(F.col("from_id").alias("id")).distinct().withColumn("has_step", F.lit(True))
    linked = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct().withColumn("linked", F.lit(True))
    kind = F.when((F.col("kind") == "JCL") & F.col("has_step"), "JOB").when((F.col("kind") == "EASYTRIEVE") & F.col("linked"), "PROGRAM").otherwise(F.col("kind"))
    typed = nodes.join(steps, "id", "left").join(linked, "id", "left").withColumn("kind", kind).select(*nodes.columns)
    jcl = nodes.filter("kind = 'JCL'").select(F.col("id").alias("from_id"))
    direct = edges.filter("kind = 'EXECUTION'").join(jcl, "from_id", "left_semi")
    return typed, edges.join(direct.select("from_id", "to_id", "kind").distinct(), ["from_id", "to_id", "kind"], "left_anti").select(*edges.columns)
