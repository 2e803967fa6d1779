"""What several operators of this subpackage share: shared folders, lineage cuts, batches by bytes, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none, as in tests on one machine.
    """
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="punchdeck-")
        spark.sparkContext.setCheckpointDir(found)
    return spark.conf.get("spark.checkpoint.dir", None) or found


#: What a worker process keeps from one task to the next; see ``lean``.
HELD: dict = {}


def give_back() -> None:
    """Return freed memory of this process to the machine: workers live on and several of them share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[..., Iterator], keeps: bool = False) -> Callable[..., Iterator]:
    """A function over batches that leaves no memory behind in its worker. ``keeps``: ``HELD`` stays for the next task."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        if not keeps:
            HELD.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action inside are deleted when it ends, not when the driver's JVM collects its plan.

    For actions whose rows are in the shared folder or on the driver by then, so that nothing reads the files again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, True)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; smaller than a checkpoint for wide rows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of whole texts have at most ``rows`` rows: ten thousand of them are tens of MB in each worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def hash_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    return near_hash(df, rows, df.count(), *columns)


def near_hash(df: DataFrame, rows: int, n: int, *columns: str) -> DataFrame:
    """``rows`` of ``n`` rows, first by a hash of ``columns``. All but about the share needed are filtered out before
    the order is taken, so no task and no driver gets more than a fixed multiple of ``rows``."""
    share = min(1.0, (2 * rows + 200) / max(1, n))
    hashed = F.xxhash64(*columns)
    near = df.filter(F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30)))
    return near.orderBy(F.pmod(hashed, F.lit(1 << 30)), *columns).limit(rows)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slice record batches so that ``column`` has about ``limit`` bytes in each; a longer value stands alone."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.binary_length(values).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, component)``, component = smallest node reachable.

    Alternating large-star and small-star steps over edges from a larger to a smaller node. Each step is an
    aggregation with map-side combine and a join, so no group of neighbours is ever collected; a node without a
    smaller neighbour keeps its edges as they are. The state is written to the shared folder after each round, with a
    mark on the edges that the round changed; a round without a mark is the last.
    An empty edge table gives an empty result; self-links and nulls are ignored.
    """

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")

    def large(e: DataFrame) -> DataFrame:
        met = e.join(lowest(e), F.col("b") == F.col("v"), "left")
        return met.select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("new"))

    def small(e: DataFrame) -> DataFrame:
        met = e.join(lowest(e), F.col("a") == F.col("v"))
        other = F.col("b") > F.col("m")
        ends = F.array(F.struct("a", F.col("m").alias("b"), (F.col("new") | other).alias("new")), F.when(other, F.struct(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("new"))))
        return met.select(F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("x")).select("x.*")

    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    for _ in range(rounds):
        now = written(small(large(now)).groupBy("a", "b").agg(F.max("new").alias("new")), "edges")
        if now.filter("new").isEmpty():
            break
        now = now.select("a", "b")
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    # a star forest: each node but the smallest of a component has one edge, to that one
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
